"""Evaluation texts leaking into training text (problem 8).

Method: spaced-seed hashing. Fixed masks of 0s and 1s slide over the words of test passages and corpus texts; the
words under the 1s are hashed, the words under the 0s ignored. Test and corpus hashes are joined, and around each
hit the aligned stretch of words is grown and verified, tolerating a stated number of substituted words.

With no substitution allowed every shared run of `min_words` words holds a hit, because no mask is longer than
`min_words`; nothing is missed. With one, each inner position of a run of 12 words is a 0 of some mask.

The test side is a stated set of held-out items. Its seeds are put into every worker only after counting them
(`seed_bound`). The seeds of a larger test set are joined: a bitmap of fixed size, made of the test seeds, drops nearly
all corpus seeds inside the scan, so the shuffle carries candidates only. Both ways give the same rows. Corpus texts are
scanned whole.

Defined results: null and short texts match nothing; a null item side is skipped; repeated rows give equal rows,
made distinct; tags in mark-up count as blanks, whatever their length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidlake.runtime import checkpointed, spread

#: Masks of span 12 and weight 8. Each inner position is a 0 in one of them, so an overlap of 12 words with
#: one substitution is always hit; without substitutions the first two are used.
MASKS = ("110110010111", "111010011011", "101101101101")
_TAG = re.compile(r"""</?[A-Za-z][\w:.-]*(?:\s+[\w:.-]+(?:\s*=\s*(?:"[^"<>]*"|'[^'<>]*'|[^\s"'<>]+))?)*\s*/?>""")
_WORD = re.compile(r"[^\W_]+")
#: Words that are hashed and looked up at once, and bits of the bitmap of test seeds.
WORDS_AT_ONCE, BITS = 200_000, 1 << 27


def words_of(text: str) -> list[str]:
    """Lower-case words of a text; tags are blanks."""
    if "<" in text:
        text = _TAG.sub(" ", text)
    return _WORD.findall(text.lower())


class _Known(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


class WordHashes:
    """64-bit hashes of words, kept between texts while there are few of them."""

    def __init__(self) -> None:
        self.known = _Known()

    def __call__(self, words: list[str]):
        import numpy as np

        if len(self.known) > 500_000:
            self.known.clear()
        return np.fromiter(map(self.known.__getitem__, words), dtype=np.uint64, count=len(words))


def grouped(texts, hashed: WordHashes):
    """Hashes of many texts at once: (first text, hashes end to end, offsets), some `WORDS_AT_ONCE` words a group."""
    import numpy as np

    group, size, first = [], 0, 0
    for n, text in enumerate(texts):
        group.append(hashed(words_of(text)))
        size += len(group[-1])
        if size >= WORDS_AT_ONCE:
            yield first, np.concatenate(group), np.cumsum([0, *map(len, group)])
            group, size, first = [], 0, n + 1
    if group:
        yield first, np.concatenate(group), np.cumsum([0, *map(len, group)])


def inside(offsets, n: int, span: int):
    """Whether each of n positions starts a window of `span` words that lies within one text, and the text's number."""
    import numpy as np

    text = np.searchsorted(offsets, np.arange(n), "right") - 1
    return np.arange(n) + span <= offsets[text + 1], text


def seeds(hashes, mask: str):
    """The hash of the words under the 1s of the mask at each position; signed 64-bit."""
    import numpy as np

    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    total = np.zeros(n, dtype=np.uint64)
    factor = 0x9E3779B97F4A7C15
    with np.errstate(over="ignore"):
        for at, bit in enumerate(mask):
            if bit == "1":
                part = hashes[at : at + n] * np.uint64(factor)
                total ^= (part ^ (part >> np.uint64(29))) * np.uint64(factor | 1)
                factor = (factor * 0xBF58476D1CE4E5B9 + 0x94D049BB133111EB) % 2**64 | 1
    return total.astype(np.int64)


def longest_overlap(a, b, diagonal: int, substitutions: int) -> tuple[int, int]:
    """(words, differing words) of the longest stretch in which b[i + diagonal] stands against a[i], at most `substitutions`
    words differ, and the first and last words are equal; (0, 0) without one."""
    import numpy as np

    start = max(0, -diagonal)
    n = min(len(a), len(b) - diagonal) - start
    if n <= 0:
        return 0, 0
    equal = a[start : start + n] == b[start + diagonal : start + diagonal + n]
    same, borders = np.flatnonzero(equal), np.concatenate(([-1], np.flatnonzero(~equal), [n]))
    if not len(same):
        return 0, 0
    reach = min(substitutions + 1, len(borders) - 1)
    first, last = np.searchsorted(same, borders[:-reach] + 1), np.searchsorted(same, borders[reach:]) - 1
    held = first <= last
    if not held.any():
        return 0, 0
    low, high = same[first[held]], same[last[held]]
    sizes = high - low + 1
    differing = sizes - (last[held] - first[held] + 1)
    best = np.lexsort((differing, -sizes))[0]
    return int(sizes[best]), int(differing[best])


def _passages(items: DataFrame, item: str, texts: list[str]) -> DataFrame:
    sides = F.array(*[F.struct(F.lit(i).alias("side"), F.col(t).alias("passage")) for i, t in enumerate(texts)])
    return items.select(F.col(item).alias("_item"), F.explode(sides).alias("_s")).select("_item", "_s.side", "_s.passage").where(F.col("passage").isNotNull()).distinct()


def leaks(
    documents: DataFrame,
    key: str,
    text: str,
    items: DataFrame,
    item: str,
    passages: list[str],
    min_words: int = 12,
    substitutions: int = 0,
    masks: tuple[str, ...] | None = None,
    seed_bound: int = 2_000_000,
) -> DataFrame:
    """(doc_id, item_id, side, overlap, differing): documents that hold at least `min_words` consecutive words of a
    passage of an item, with the longest overlap of each item and side (the index in `passages`)."""
    import numpy as np

    masks = masks or (MASKS if substitutions else MASKS[:2])
    if any(len(m) > min_words for m in masks):
        raise ValueError("no mask may be longer than min_words")
    source = spread(documents.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where(F.col(text).isNotNull()))
    tests = _passages(items, item, passages)
    kind, item_kind = source.schema["_key"].dataType.simpleString(), tests.schema["_item"].dataType.simpleString()
    spark = documents.sparkSession
    size = tests.agg(F.coalesce(F.sum(F.length("passage")), F.lit(0)).alias("n")).first()["n"]
    if size * len(masks) // 2 <= seed_bound:  # a word takes two characters at least, so seeds <= this
        rows = [tuple(r) for r in tests.collect()]
        shared = spark.sparkContext.broadcast(rows)

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            hashed, own = WordHashes(), []
            lists: list[list] = [[] for _ in masks]
            for number, (_, _, passage) in enumerate(shared.value):
                own.append(hashed(words_of(passage)))
                for m, mask in enumerate(masks):
                    s = seeds(own[-1], mask)
                    lists[m].append(np.stack([s, np.full(len(s), number), np.arange(len(s))]))
            by_mask = [np.concatenate(part, axis=1) if part else np.empty((3, 0), dtype=np.int64) for part in lists]
            by_mask = [part[:, np.argsort(part[0], kind="stable")] for part in by_mask]
            for batch in batches:
                keys, out = batch["_key"].to_list(), []
                for first, words, offsets in grouped(batch["_text"], hashed):
                    met: set[tuple[int, int, int]] = set()
                    for mask, part in zip(masks, by_mask):
                        s = seeds(words, mask)
                        if not part.shape[1] or not len(s):
                            continue
                        low = np.searchsorted(part[0], s, "left")
                        whole, text = inside(offsets, len(s), len(mask))
                        hits = np.flatnonzero((part[0][np.minimum(low, part.shape[1] - 1)] == s) & whole)
                        for some in np.array_split(hits, 1 + len(hits) // 1000):  # seeds of repetitive texts meet many times
                            many = np.searchsorted(part[0], s[some], "right") - low[some]
                            at = np.repeat(low[some] - np.cumsum(many) + many, many) + np.arange(many.sum())
                            j = np.repeat(some, many)
                            met |= set(zip(text[j].tolist(), part[1, at].tolist(), (j - offsets[text[j]] - part[2, at]).tolist()))
                    best: dict[tuple[int, int], tuple[int, int]] = {}
                    for t, number, diagonal in met:
                        size, differing = longest_overlap(own[number], words[offsets[t] : offsets[t + 1]], diagonal, substitutions)
                        if size >= min_words:
                            best[t, number] = max(best.get((t, number), (0, 0)), (size, -differing))
                    out += [(keys[first + t], shared.value[n][0], shared.value[n][1], size, -d) for (t, n), (size, d) in best.items()]
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "side", "overlap", "differing"])

        return source.mapInPandas(scan, f"doc_id {kind}, item_id {item_kind}, side int, overlap int, differing int").distinct()
    return _joined(source, tests, min_words, substitutions, masks, kind, item_kind)


def _joined(source: DataFrame, tests: DataFrame, min_words: int, substitutions: int, masks, kind: str, item_kind: str) -> DataFrame:
    """The same result for a test set of any size: seeds of both sides meet in a shuffle, then texts are verified."""

    def seeded(df: DataFrame, names: list[str], text: str, schema: str, bits=None) -> DataFrame:
        """Distinct seeds of each text; with `bits`, a broadcast bitmap, only those whose bit is set."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import numpy as np

            hashed = WordHashes()
            for batch in batches:
                for first, words, offsets in grouped(batch[text], hashed):
                    for m, mask in enumerate(masks):
                        s = seeds(words, mask)
                        whole, number = inside(offsets, len(s), len(mask))
                        if bits is not None:
                            slot = s & (BITS - 1)
                            whole &= (bits.value[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
                        at = pd.DataFrame({"text": number[whole], "seed": s[whole]}).drop_duplicates()
                        rows = batch[names].iloc[first + at["text"].to_numpy()].reset_index(drop=True)
                        yield rows.assign(mask=m, seed=at["seed"].to_numpy())

        return df.mapInPandas(run, schema + ", mask int, seed bigint")

    tests = checkpointed(tests.withColumnRenamed("_item", "item"))
    test_seeds = checkpointed(seeded(tests, ["item", "side"], "passage", f"item {item_kind}, side int"))
    shared = source.sparkSession.sparkContext.broadcast(_bitmap(test_seeds))
    docs = source.withColumnRenamed("_key", "key").withColumnRenamed("_text", "body")
    hits = seeded(docs, ["key"], "body", f"key {kind}", shared).join(test_seeds, ["mask", "seed"]).select("key", "item", "side").distinct()
    both = hits.join(docs, "key").join(tests, ["item", "side"])

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        hashed = WordHashes()
        for batch in batches:
            out = []
            for item, side, key, body, passage in zip(*(batch[c] for c in ("item", "side", "key", "body", "passage"))):
                a, b = hashed(words_of(passage)), hashed(words_of(body))
                met: set[int] = set()
                for mask in masks:
                    x, y = seeds(a, mask), seeds(b, mask)
                    for j in np.flatnonzero(np.isin(y, x)):
                        met |= set((j - np.flatnonzero(x == y[j])).tolist())
                best = max((longest_overlap(a, b, d, substitutions) for d in met), key=lambda v: (v[0], -v[1]), default=(0, 0))
                if best[0] >= min_words:
                    out.append((key, item, side, *best))
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "side", "overlap", "differing"])

    return both.mapInPandas(verify, f"doc_id {kind}, item_id {item_kind}, side int, overlap int, differing int").distinct()


def _bitmap(test_seeds: DataFrame):
    """`BITS` bits as bytes, those of the low bits of all test seeds set; at most BITS / 8 bytes reach the driver."""
    import numpy as np

    # Buckets of the built-in bitmaps have 32,768 bits and are numbered from 1.
    slot = F.col("seed").bitwiseAND(F.lit(BITS - 1)) + 1
    parts = test_seeds.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    out = np.zeros(BITS // 8, dtype=np.uint8)
    for r in parts.toLocalIterator():
        own = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
        out[(r["bucket"] - 1) * 4096 : (r["bucket"] - 1) * 4096 + len(own)] = own
    return out
