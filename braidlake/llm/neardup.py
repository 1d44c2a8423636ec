"""Near-duplicate records with small edits (problem 5).

Method: tiled exact comparison. Records become sets of hashed word runs and, besides, bit sketches in which every
run flips one bit, so that the exclusive-or of two sketches is the sketch of the symmetric difference and its bit
count a lower bound of it. Sketches are compared with numpy exclusive-or and bit counts, tile by tile; tile pairs whose
set sizes differ beyond the radius are skipped. What passes is checked on the full sets. No step loses a pair.

All tiles of a large collection can't be compared with all others, so records first meet by the rarest runs of their
sets (prefix filter): two sets of similarity t share a run among the (1 - t) n + 1 rarest of each, and must share the
more of them the larger they are, since what lies outside both prefixes can't make up for it (`least_common`). Runs count
only as far from the start of both prefixes as `reach` says. Meetings are counted per pair, and only pairs that reach
their number are compared. Runs of more than `MEET` records aren't counted: each is cut into pairs of tiles, each a task
of its own, whose sketches are compared whole.

Rarity is that of a table of hashed counts over all records, whose size follows the number of words. It only has to tell
common runs from others: any fixed order loses no pair, and no count is too low, so a run counted once is nobody else's
and drops out. Records with equal sets are collapsed to one first, so copies cost nothing beyond their membership row.

Sets are several times as large as the texts as they are stored, so none is: they are made of the texts once to count runs
and once for prefixes, digests and sketches, and a third time only for records of pairs that passed everything before.
Shuffled are run numbers and pairs of records; sketches travel in passes of limited size, and what a step has shuffled is
removed as soon as its result is written.

Defined results: null texts and texts of fewer words than a run have no partner; texts are read whole; repeated rows
count once; records with equal sets of runs are partners of similarity 1.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidlake.operators.graph import connected_components
from braidlake.runtime import checkpointed, python_tasks, spread

_WORD = re.compile(r"[^\W_]+")
WIDTHS = (512, 1024, 2048, 4096)
#: Bits of the hash in the table of counts, at least and at most; segments it travels in; bits of the map of texts whose sets are needed.
COUNT_BITS, SEGMENTS, MAP_BITS = (22, 25), 16, 24
#: Records of a run up to which its pairs are counted one by one.
MEET = 32
#: Shared runs up to which pairs are counted, at most (two bits): the more, the fewer pairs are left, but the farther prefixes reach.
SHARED = 3
#: Counts up to this are exact in the table; above, each of the codes up to 255 stands for a fifth more than the one before.
EXACT = 200
#: Bytes of sketches and rows that a pass over tiles may shuffle, at least.
PASS_BYTES = 25_000_000
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class _Known(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


class RunHashes:
    """Sorted distinct 64-bit hashes of the runs of `size` consecutive words of a text."""

    def __init__(self, size: int) -> None:
        self.size, self.known = size, _Known()

    def __call__(self, text: str, scope: str = ""):
        import numpy as np

        runs, _ = self.flat([text], [scope])
        return np.unique(runs).view(np.int64) if len(runs) else None

    def flat(self, texts: list[str], scopes: list[str]):
        """The hashes of all runs of the texts, in order and with repeats, and how many each text has."""
        import numpy as np
        import xxhash

        if len(self.known) > 500_000:
            self.known.clear()
        words = [_WORD.findall(t.lower()) for t in texts]
        many = np.array([len(w) for w in words], dtype=np.int64)
        hashes = np.fromiter(map(self.known.__getitem__, chain.from_iterable(words)), dtype=np.uint64, count=many.sum())
        n = max(0, len(hashes) - self.size + 1)
        seeds = {s: xxhash.xxh3_64_intdigest(s) if s else 0 for s in set(scopes)}
        total = np.repeat(np.array([seeds[s] for s in scopes], dtype=np.uint64), many)[:n]
        for k in range(self.size):
            total = (total ^ hashes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            total ^= total >> np.uint64(32)
        rest = (np.repeat(np.cumsum(many), many) - np.arange(len(hashes)))[:n]
        return total[rest >= self.size], np.maximum(many - self.size + 1, 0)

    def batches(self, batch: pd.DataFrame, step: int = 500_000):
        """(rows, runs, numbers of runs) of `flat`, some texts of the batch at once."""
        import numpy as np

        texts, scopes = list(batch["_text"]), list(batch["_scope"])
        borders = np.flatnonzero(np.diff(np.cumsum([len(t) for t in texts]) // step)) + 1
        for rows in np.split(np.arange(len(texts)), borders) if texts else ():
            yield rows, *self.flat([texts[k] for k in rows], [scopes[k] for k in rows])

    def sets(self, batch: pd.DataFrame):
        """(row, sorted distinct runs) of the texts that have any."""
        import numpy as np

        for rows, runs, many in self.batches(batch):
            for k, own in zip(rows, np.split(runs, np.cumsum(many)[:-1])):
                if len(own):
                    yield k, np.unique(own).view(np.int64)


def sketch(runs) -> bytes:
    """The sketch of a set: each run flips the bit its hash names. Larger sets get wider sketches, from 512 to 4096 bits.

    A sketch is narrowed by exclusive-or of its halves, so sketches of different widths compare at the lesser one.
    """
    import numpy as np

    width = next((w for w in WIDTHS if len(runs) <= 0.6 * w), WIDTHS[-1])
    bits = np.bincount((runs.view(np.uint64) >> np.uint64(7)) & np.uint64(width - 1), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


class Sketches:
    """Sketches of several sets, narrowed to every width they reach."""

    def __init__(self, marks) -> None:
        import numpy as np

        self.bits = np.array([8 * len(m) for m in marks])
        self.at = {}
        for w in WIDTHS:
            rows = np.flatnonzero(self.bits == w)
            if not len(rows):
                continue
            words = np.frombuffer(b"".join(bytes(marks[r]) for r in rows), dtype=np.uint64).reshape(len(rows), w // 64)
            for narrow in reversed(WIDTHS[: WIDTHS.index(w) + 1]):
                while words.shape[1] > narrow // 64:
                    half = words.shape[1] // 2
                    words = words[:, :half] ^ words[:, half:]
                self.at.setdefault(narrow, np.zeros((len(marks), narrow // 64), dtype=np.uint64))[rows] = words

    def apart(self, i, j):
        """A lower bound of the symmetric difference of each pair of sets."""
        import numpy as np

        out = np.empty(len(i), dtype=np.int64)
        width = np.minimum(self.bits[i], self.bits[j])
        for w in np.unique(width):
            at = np.flatnonzero(width == w)
            marks = self.at[int(w)]
            out[at] = np.bitwise_count(marks[i[at]] ^ marks[j[at]]).sum(axis=1)
        return out


def _kept(df: DataFrame) -> DataFrame:
    """`checkpointed`, and what was shuffled for it is removed at once instead of at some collection of the driver's garbage."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP)
    conf.set(_CLEANUP, "true")
    try:
        return checkpointed(df.select("*"))  # the plan takes the setting when it is made
    finally:
        conf.set(_CLEANUP, before)


def _texts(df: DataFrame, key: str, text: str, scope: str | None) -> DataFrame:
    """(key, _text, _scope, tid): records with a key and a text; tid is a hash of scope and text.

    Records of different scopes share no run: the scope's hash is part of each.
    """
    own = F.coalesce(F.col(scope).cast("string"), F.lit("")) if scope else F.lit("")
    rows = df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("_text"), own.alias("_scope")).where(F.col("_text").isNotNull() & F.col("key").isNotNull())
    return spread(rows.withColumn("tid", F.xxhash64("_scope", "_text")))


def _code(counts):
    """Counts as one byte each, see `EXACT`."""
    import numpy as np

    high = EXACT + np.ceil(np.log(np.maximum(counts, EXACT) / EXACT) / np.log(1.2) - 1e-9)
    return np.where(counts <= EXACT, counts, np.minimum(high, 255)).astype(np.uint8)


def _most():
    """The largest count that each code stands for."""
    import numpy as np

    codes = np.arange(256)
    return np.where(codes <= EXACT, codes, np.ceil(EXACT * 1.2 ** np.maximum(codes - EXACT, 0))).astype(np.int64)


def _hashed_counts(texts: DataFrame, words: int, bits: int) -> list[bytes]:
    """Codes of the counts of runs by a hash of `bits` bits, over all records, in packed segments.

    Tasks send their counts in packed segments, which are added segment by segment; `SEGMENTS` rows reach the driver.
    """
    import numpy as np

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, hashes = np.zeros(1 << bits, dtype=np.uint32), RunHashes(words)
        for batch in batches:
            for _, runs, _ in hashes.batches(batch):
                slots, n = np.unique((runs & np.uint64((1 << bits) - 1)).astype(np.int32), return_counts=True)
                total[slots] += n.astype(np.uint32)
        yield pd.DataFrame({"segment": range(SEGMENTS), "counts": [zlib.compress(x.tobytes(), 1) for x in np.split(total, SEGMENTS)]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, object] = {}
        for batch in batches:
            for segment, packed in zip(batch["segment"], batch["counts"]):
                own = np.frombuffer(zlib.decompress(packed), dtype=np.uint32)
                sums[segment] = sums[segment] + own if segment in sums else own.astype(np.uint64)
        yield pd.DataFrame({"segment": list(sums), "counts": [zlib.compress(_code(x).tobytes(), 1) for x in sums.values()]})

    schema = "segment int, counts binary"
    rows = _kept(texts.select("_text", "_scope").mapInPandas(count, schema).repartition(SEGMENTS, "segment").mapInPandas(add, schema)).collect()
    empty = zlib.compress(bytes((1 << bits) // SEGMENTS), 1)
    return [{r["segment"]: bytes(r["counts"]) for r in rows}.get(k, empty) for k in range(SEGMENTS)]


def prefix_size(n, threshold: float):
    """How many of its rarest runs a set of n runs meets others by."""
    import numpy as np

    return n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1


def least_common(n, m, threshold: float):
    """How many runs of both prefixes two sets of n and m runs must share at least to be similar.

    Sets of similarity t have at least t / (1 + t) (n + m) runs in common. Those up to the less common of both prefixes'
    ends lie in both prefixes; what comes after lies outside of one of them, hence is at most the larger rest.
    """
    import numpy as np

    common = np.ceil(threshold / (1 + threshold) * (n + m) - 1e-9).astype(np.int64)
    return np.maximum(1, common - np.maximum(n - prefix_size(n, threshold), m - prefix_size(m, threshold)))


def reach(n, m, threshold: float):
    """(ends, ends, shared): sets of n and m runs that are similar share at least `shared` of the runs before both ends.

    Of the runs they have in common, the k-th is followed by all the later ones in both sets, so it stands so many runs
    from the end at least.
    """
    import numpy as np

    common = np.ceil(threshold / (1 + threshold) * (n + m) - 1e-9).astype(np.int64)
    shared = np.minimum(least_common(n, m, threshold), SHARED)
    return n - common + shared, m - common + shared, shared


def _prefixes(texts: DataFrame, words: int, threshold: float, packed: list[bytes], bits: int, tile: int, meet: int) -> DataFrame:
    """(key, digest, tid, n, bits, alone, cold, warm, tiles, weight): records with a set, by their rarest runs.

    digest is a 128-bit hash of the set and bits its sketch. The runs, as many as the threshold needs, are shortened to
    32 bits. In order come those counted once, whose number is `alone`, `cold` and `warm`, whose count in the table exceeds
    `meet`; tiles is the number of tiles of each of the last, and weight what their rows take in a shuffle, about.
    """
    shared = texts.sparkSession.sparkContext.broadcast(packed)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np
        import xxhash

        rare, most, mask = np.frombuffer(b"".join(map(zlib.decompress, shared.value)), dtype=np.uint8), _most(), (1 << bits) - 1
        hashes = RunHashes(words)
        for batch in batches:
            rows, digests, sizes, marks, alone, cold, warm, tiles, weights = [], [], [], [], [], [], [], [], []
            for k, r in hashes.sets(batch):
                codes = rare[r & mask]
                order = np.argsort(codes, kind="stable")[: int(prefix_size(np.int64(len(r)), threshold))]
                counts = most[codes[order]]
                own = r[order].view(np.uint64).astype(np.uint32).view(np.int32)
                few, hot = np.searchsorted(counts, [min(1, meet), meet], side="right")
                many = -(-counts[hot:] // tile)
                rows.append(k)
                digests.append(xxhash.xxh3_128_digest(r.tobytes()))
                sizes.append(len(r))
                marks.append(sketch(r))
                alone.append(few)
                cold.append(own[few:hot])
                warm.append(own[hot:])
                tiles.append(many.astype(np.int32))
                weights.append(int(many.sum()) * (len(marks[-1]) + 40))
            plain = lambda xs: pd.Series(xs, dtype=object)
            own = batch.iloc[rows]
            yield pd.DataFrame({"key": own["key"].to_numpy(), "digest": plain(digests), "tid": own["tid"].to_numpy(), "n": np.array(sizes, dtype=np.int32), "bits": plain(marks), "alone": np.array(alone, dtype=np.int32), "cold": plain(cold), "warm": plain(warm), "tiles": plain(tiles), "weight": np.array(weights, dtype=np.int64)})

    return texts.mapInPandas(cut, "key string, digest binary, tid bigint, n int, bits binary, alone int, cold array<int>, warm array<int>, tiles array<int>, weight bigint")


def near_pairs(sizes, marks: Sketches, i, j, threshold: float, block: int = 100_000):
    """The index pairs whose sizes and sketches allow the threshold, block by block."""
    import numpy as np

    out_i, out_j = [i[:0]], [j[:0]]
    for at in range(0, len(i), block):
        x, y = i[at : at + block], j[at : at + block]
        a, b = sizes[x], sizes[y]
        keep = np.minimum(a, b) >= threshold * np.maximum(a, b) - 1e-9
        x, y = x[keep], y[keep]
        near = marks.apart(x, y) <= (sizes[x] + sizes[y]) * ((1 - threshold) / (1 + threshold)) + 1e-9
        out_i.append(x[near])
        out_j.append(y[near])
    return np.concatenate(out_i), np.concatenate(out_j)


def compare_tile(sizes, marks: Sketches, left, right, threshold: float, step: int = 256):
    """Index pairs of left x right that pass `near_pairs`, tile by tile.

    Rows must be sorted by size; tiles of `step` rows are skipped when even their nearest sizes are too far apart.
    """
    import numpy as np

    out_i, out_j = [left[:0]], [right[:0]]
    for a in range(0, len(left), step):
        i = left[a : a + step]
        for b in range(0, len(right), step):
            j = right[b : b + step]
            if sizes[i[-1]] < threshold * sizes[j[0]] or sizes[j[-1]] < threshold * sizes[i[0]]:
                continue
            x, y = near_pairs(sizes, marks, np.repeat(i, len(j)), np.tile(j, len(i)), threshold)
            out_i.append(x)
            out_j.append(y)
    return np.concatenate(out_i), np.concatenate(out_j)


def _by_run(batches: Iterator[pd.DataFrame], columns: list[str]):
    """(rows, starts, ends) of whole groups of the sorted `columns`, some batches at once."""
    import numpy as np

    rest: pd.DataFrame | None = None
    for batch in batches:
        rest = batch if rest is None or not len(rest) else pd.concat([rest, batch], ignore_index=True)
        if not len(rest):
            continue
        ids = rest[columns].to_numpy()
        change = np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1
        if len(change):
            yield rest.iloc[: change[-1]], np.concatenate(([0], change[:-1])), change
            rest = rest.iloc[change[-1] :].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest, np.array([0]), np.array([len(rest)])


def partners(starts, ends, sizes, threshold: float, step: int = 2_000_000):
    """Pairs of rows i < j of one group, of groups sorted by size, whose sizes allow the threshold; about `step` at once."""
    import numpy as np

    group, rows = np.repeat(np.arange(len(starts)), ends - starts), np.arange(starts[0], ends[-1])
    wide = int(sizes.max()) + 1
    last = np.searchsorted(group * wide + sizes[rows], group * wide + np.minimum(sizes[rows] / threshold + 1e-6, wide - 1).astype(np.int64), side="right")
    many = last + starts[0] - rows - 1
    for some in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(np.cumsum(many) // step)) + 1):
        n = many[some]
        i = np.repeat(rows[some], n)
        yield i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)


def _met(prefixes: DataFrame, threshold: float, places: int) -> DataFrame:
    """Distinct (rec_a, rec_b), rec_a < rec_b, that share as many cold runs as `reach` asks for.

    Rows travel as two numbers, run and size, and record and place. A place has `places` bits; where these are too few, an
    earlier one stands for it, which keeps more pairs and loses none.
    """
    rows = prefixes.select("rec", "n", "alone", F.posexplode("cold").alias("at", "run"))
    place = F.least(F.col("alone") + F.col("at"), F.lit((1 << places) - 1))
    packed = rows.select(F.shiftleft(F.col("run").cast("bigint"), 32).bitwiseOR(F.col("n")).alias("run_n"), F.shiftleft("rec", places).bitwiseOR(place).alias("rec_at"))
    grouped = packed.repartition(python_tasks(rows.sparkSession), F.shiftright("run_n", 32)).sortWithinPartitions("run_n", "rec_at")

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for batch in batches:
            run_n, rec_at = batch["run_n"].to_numpy(np.int64), batch["rec_at"].to_numpy(np.int64)
            yield pd.DataFrame({"run": run_n >> 32, "n": run_n & 0xFFFFFFFF, "rec": rec_at >> places, "at": rec_at & ((1 << places) - 1)})

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for group, starts, ends in _by_run(split(batches), ["run"]):
            recs, sizes, at = (group[c].to_numpy() for c in ("rec", "n", "at"))
            for i, j in partners(starts, ends, sizes, threshold):
                end_i, end_j, least = reach(sizes[i], sizes[j], threshold)
                met = (at[i] < end_i) & (at[j] < end_j) & (recs[i] != recs[j])
                a, b = recs[i[met]], recs[j[met]]
                yield pd.DataFrame({"rec_a": np.minimum(a, b) << 2 | least[met], "rec_b": np.maximum(a, b)})

    counted = grouped.mapInPandas(pairs, "rec_a bigint, rec_b bigint").groupBy("rec_a", "rec_b").agg(F.count("*").alias("_n"))
    return counted.where(F.col("_n") >= F.col("rec_a").bitwiseAND(F.lit(3))).select(F.shiftright("rec_a", 2).alias("rec_a"), "rec_b")


def _tiled(prefixes: DataFrame, threshold: float, part: int, parts: int) -> DataFrame:
    """Distinct (rec_a, rec_b), rec_a < rec_b, that meet in a warm run and pass the comparison of sketches; `part` of the runs."""
    met = prefixes.select("rec", "n", "bits", F.inline(F.arrays_zip("warm", "tiles"))).withColumnRenamed("warm", "run").where(F.pmod("run", F.lit(parts)) == part)
    mine = F.pmod(F.xxhash64("rec"), F.col("tiles")).cast("int")
    placed = (
        met.withColumn("_mine", mine)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select("run", "rec", "n", "bits", F.least("_mine", "_other").alias("low"), F.greatest("_mine", "_other").alias("high"), (F.col("_mine") <= F.col("_other")).alias("left"))
    )
    grouped = placed.repartition(python_tasks(prefixes.sparkSession), "run", "low", "high").sortWithinPartitions("run", "low", "high", "n", "rec")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for group, starts, ends in _by_run(batches, ["run", "low", "high"]):
            sizes, recs, marks = group["n"].to_numpy(np.int64), group["rec"].to_numpy(), Sketches(group["bits"].to_numpy())
            side, low, high = group["left"].to_numpy(bool), group["low"].to_numpy(), group["high"].to_numpy()
            found = []
            for s, e in zip(starts, ends):
                if e - s < 2:
                    continue
                here, own = np.arange(s, e), side[s:e]
                if low[s] == high[s]:
                    i, j = compare_tile(sizes, marks, here, here, threshold)
                    found.append((i[i < j], j[i < j]))
                elif own.any() and not own.all():
                    found.append(compare_tile(sizes, marks, here[own], here[~own], threshold))
            if found:
                a, b = (recs[np.concatenate(x)] for x in zip(*found))
                yield pd.DataFrame({"rec_a": np.minimum(a, b)[a != b], "rec_b": np.maximum(a, b)[a != b]}).drop_duplicates()

    return grouped.mapInPandas(compare, "rec_a bigint, rec_b bigint").distinct()


def _near(pairs: DataFrame, records: DataFrame, threshold: float) -> DataFrame:
    """Those of the pairs whose sizes and sketches allow the threshold."""
    side = lambda x: records.select(*[F.col(c).alias(f"{c}_{x}") for c in ("rec", "n", "bits")])

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for batch in batches:
            if not len(batch):
                continue
            i = np.arange(len(batch))
            sizes, marks = np.concatenate([batch["n_a"], batch["n_b"]]).astype(np.int64), Sketches([*batch["bits_a"], *batch["bits_b"]])
            near, _ = near_pairs(sizes, marks, i, i + len(batch), threshold)
            yield batch.iloc[near][["rec_a", "rec_b"]]

    return pairs.join(side("a"), "rec_a").join(side("b"), "rec_b").mapInPandas(compare, "rec_a bigint, rec_b bigint")


def _paired_sets(pairs: DataFrame, records: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """(rec, runs) of the records in `pairs`, made of their texts again.

    A map of `MAP_BITS` hashed bits drops nearly all other texts before that.
    """
    import numpy as np

    recs = pairs.select(F.col("rec_a").alias("rec")).union(pairs.select("rec_b")).distinct()
    wanted = _kept(records.select("rec", "digest", "tid").join(recs, "rec"))
    slot = F.col("tid").bitwiseAND(F.lit((1 << MAP_BITS) - 1)) + 1
    rows = wanted.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).collect()  # 512 rows of 4 KB at most
    bitmap = np.zeros(1 << (MAP_BITS - 3), dtype=np.uint8)
    for r in rows:
        bitmap[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = np.frombuffer(bytes(r["bits"]).ljust(4096, b"\0"), dtype=np.uint8)
    shared = texts.sparkSession.sparkContext.broadcast(zlib.compress(bitmap.tobytes(), 1))

    def kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        known, hashes = np.frombuffer(zlib.decompress(shared.value), dtype=np.uint8), RunHashes(words)
        for batch in batches:
            at = batch["tid"].to_numpy(np.int64) & ((1 << MAP_BITS) - 1)
            sets = [r for _, r in hashes.sets(batch[(known[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1])]
            plain = lambda xs: pd.Series(xs, dtype=object)
            yield pd.DataFrame({"digest": plain([xxhash.xxh3_128_digest(r.tobytes()) for r in sets]), "runs": plain(sets)})

    sets = texts.select("_text", "_scope", "tid").mapInPandas(kept, "digest binary, runs array<bigint>")
    return wanted.select("rec", "digest").join(sets, "digest").dropDuplicates(["digest"]).select("rec", "runs")


def near_duplicates(
    df: DataFrame, key: str, text: str, words: int = 5, threshold: float = 0.8, scope: str | None = None, tile: int = 2000, meet: int = MEET
) -> tuple[DataFrame, DataFrame]:
    """Two tables: members (key, rec) that map each record to the representative of its set, and links
    (rec_a, rec_b, similarity) between representatives of different sets. Only records of one scope are compared."""
    texts = _texts(df, key, text, scope)
    chars = texts.agg(F.coalesce(F.sum(F.length("_text").cast("bigint")), F.lit(0)).alias("n")).first()["n"]
    bits = min(max((chars // 6).bit_length() - 1, COUNT_BITS[0]), COUNT_BITS[1])
    records = checkpointed(_prefixes(texts, words, threshold, _hashed_counts(texts, words, bits), bits, tile, meet).withColumn("rec", F.monotonically_increasing_id()))
    # Only digests are shuffled to find copies.
    first = _kept(records.groupBy("digest").agg(F.min("rec").alias("first"), F.count("*").alias("copies")))
    members = records.select("key", "digest").distinct().join(first.select("digest", F.col("first").alias("rec")), "digest").select("key", "rec")
    copies = _kept(records.select("rec", "digest").join(first.where("copies > 1"), "digest").where("rec <> first").select("rec"))
    single = lambda *columns: records.select("rec", "n", *columns).join(copies, "rec", "left_anti")

    over = records.agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("weight"), F.coalesce(F.max("rec"), F.lit(0)).alias("rec")).first()
    pairs = _kept(_near(_kept(_met(single("alone", "cold"), threshold, min(31, 62 - over["rec"].bit_length()))), records, threshold))
    parts = -(-over["weight"] // max(PASS_BYTES, chars // 4))
    for part in range(parts):
        pairs = pairs.unionByName(_kept(_tiled(single("bits", "warm", "tiles").where(F.size("warm") > 0), threshold, part, parts)))
    pairs = pairs.distinct()

    own = _kept(_paired_sets(pairs, records, texts, words))
    met = pairs.join(own.select(F.col("rec").alias("rec_a"), F.col("runs").alias("runs_a")), "rec_a").join(own.select(F.col("rec").alias("rec_b"), F.col("runs").alias("runs_b")), "rec_b")
    # Sets are intersected inside the JVM: long sets would make Arrow batches of many rows too large.
    common = F.size(F.array_intersect("runs_a", "runs_b"))
    similarity = common / (F.size("runs_a") + F.size("runs_b") - common)
    return members, met.select("rec_a", "rec_b", similarity.alias("similarity")).where(F.col("similarity") >= threshold)


def near_duplicate_pairs(df: DataFrame, key: str, text: str, words: int = 5, threshold: float = 0.8, scope: str | None = None) -> DataFrame:
    """(key_a, key_b): all pairs of different keys of one scope whose texts reach the threshold, key_a < key_b as strings."""
    members, links = near_duplicates(df, key, text, words, threshold, scope)
    equal = members.select("rec", F.col("key").alias("key_a")).join(members.select("rec", F.col("key").alias("key_b")), "rec").where("key_a < key_b").select("key_a", "key_b")
    left = members.select(F.col("rec").alias("rec_a"), F.col("key").alias("_x"))
    right = members.select(F.col("rec").alias("rec_b"), F.col("key").alias("_y"))
    other = links.join(left, "rec_a").join(right, "rec_b").where("_x <> _y").select(F.least("_x", "_y").alias("key_a"), F.greatest("_x", "_y").alias("key_b"))
    return equal.unionByName(other).distinct()


def near_duplicate_groups(df: DataFrame, key: str, text: str, words: int = 5, threshold: float = 0.8, scope: str | None = None) -> DataFrame:
    """(key, group_id, group_size): one row per record; groups are connected by links, a record without a partner is alone.

    Copies are never paired: they share the representative of their set.
    """
    members, links = near_duplicates(df, key, text, words, threshold, scope)
    components = connected_components(links.select(F.col("rec_a").alias("src"), F.col("rec_b").alias("dst")))
    grouped = members.join(components.select(F.col("node").alias("rec"), "component"), "rec", "left").withColumn("_group", F.coalesce("component", "rec"))
    # Partial counts and minima are taken before the shuffle, so a group of any size sends one row per task.
    sizes = grouped.groupBy("_group").agg(F.min("key").alias("group_id"), F.count_distinct("key").alias("group_size"))
    return grouped.select("key", "_group").distinct().join(sizes, "_group").select("key", "group_id", "group_size")
