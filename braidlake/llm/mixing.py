"""Mixing sources to target weights (problem 9).

Method: entropy balancing. Every document of a source gets a rate; among all rates that give the source its share
of tokens and exceed no cap, those nearest (in relative entropy) to one copy of each document are exp(lambda x
tokens), cut at the cap. The lambdas solve a convex dual by Newton steps, each one aggregation over the whole corpus
(per source and token count, so that documents of equal size are counted once). Rates become whole copies by a
hash of the document and a threshold per source, itself fitted by an aggregation so that the source's total holds.

The total is the largest for which every source that has tokens reaches its target exactly within the caps, unless
`total_tokens` is given; then sources that are too small are repeated up to their cap and the shares really reached are
reported. A source with a target and no tokens is reported with a share of 0, and the others keep their proportions.

Defined results: documents with a null key, null source, a source without a target, or without tokens get no copies;
null or non-positive shares count as no target; targets are brought to a sum of 1; repeated rows count once; two different
targets of one source, and rates that don't settle, are errors.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidlake.runtime import checkpointed, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published split pattern of this byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BINS = 4096
#: Up to so many sources, tables of one row per source are broadcast.
FEW_SOURCES = 10_000


def _few(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= FEW_SOURCES else df


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, key: str, text: str, keep: list[str], tokenizer: str = TOKENIZER) -> DataFrame:
    """(key, *keep, tokens): tokens of the whole text; null text has 0."""
    source = spread(df.select(key, *keep, F.col(text).alias("_text")))
    kept = [key, *keep]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = _encoding(tokenizer)
        for batch in batches:
            out = batch[kept].copy()
            out["tokens"] = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch["_text"]]
            yield out

    schema = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in kept)
    return source.mapInPandas(count, f"{schema}, tokens bigint")


def _largest_total(sizes: dict[str, tuple[int, int]], targets: dict[str, tuple[float, int]]) -> float:
    return min((sizes[s][0] * cap / share for s, (share, cap) in targets.items() if s in sizes), default=0.0)


def solve_rates(sized: DataFrame, targets: dict[str, tuple[float, int]], total: float, sizes: dict, rounds: int = 100, close: float = 1e-9) -> dict[str, tuple[float, float]]:
    """(lambda, scale) per source: rate = least(cap, exp(lambda * tokens / scale)).

    `sized` holds (source, tokens, n). A round is one aggregation of the rates' token sum and its slope per source;
    a Newton step that leaves the bracket of the monotone equation is replaced by bisection.
    """
    state = {}
    for source, (share, cap) in targets.items():
        tokens, documents = sizes.get(source, (0, 0))
        goal = min(share * total, tokens * cap)
        if tokens:
            state[source] = {"at": 0.0, "low": -math.inf, "high": math.inf, "goal": goal, "cap": cap, "scale": tokens / documents, "full": goal >= tokens * cap * (1 - 1e-12)}
    open_ = {s for s, x in state.items() if not x["full"]}
    for _ in range(rounds):
        if not open_:
            break
        spark = sized.sparkSession
        rows = [(s, state[s]["at"], float(state[s]["cap"]), state[s]["scale"]) for s in open_]
        now = spark.createDataFrame(rows, "source string, at double, cap double, scale double")
        x = F.col("tokens") / F.col("scale")
        rate = F.least(F.col("cap"), F.exp(F.least(F.lit(50.0), F.col("at") * x)))
        free = F.when(rate < F.col("cap"), rate).otherwise(0.0)
        sums = sized.join(_few(now, len(rows)), "source").groupBy("source").agg(F.sum(rate * x * F.col("n")).alias("f"), F.sum(free * x * x * F.col("n")).alias("slope"))
        for row in sums.collect():
            s = state[row["source"]]
            gap = row["f"] - s["goal"] / s["scale"]
            if abs(gap) <= close * max(1.0, s["goal"] / s["scale"]):
                open_.discard(row["source"])
                continue
            s["low" if gap < 0 else "high"] = s["at"]
            step = s["at"] - gap / row["slope"] if row["slope"] > 0 else math.inf
            if not s["low"] < step < s["high"] or math.isinf(step):
                if math.isinf(s["low"]) or math.isinf(s["high"]):
                    step = s["at"] + (4.0 if gap < 0 else -4.0)
                else:
                    step = (s["low"] + s["high"]) / 2
            if abs(step - s["at"]) < 1e-14:
                open_.discard(row["source"])
            s["at"] = step
    if open_:
        raise RuntimeError(f"rates of {sorted(open_)} didn't settle in {rounds} rounds")
    return {s: (math.inf if x["full"] else x["at"], x["scale"]) for s, x in state.items()}


def mixture(
    documents: DataFrame, key: str, text: str, source: str, targets: DataFrame, total_tokens: int | None = None, tokenizer: str = TOKENIZER
) -> tuple[DataFrame, DataFrame]:
    """Two tables: per document (doc_id, source, tokens, rate, copies) and per source (source, target_share,
    max_repeats, documents, available_tokens, mixed_tokens, actual_share).

    `targets` has (source, target_share, max_repeats), one row per source; it is small by nature (a row per source).
    """
    wanted = targets.select("source", "target_share", "max_repeats").where("source is not null and target_share > 0 and max_repeats > 0").distinct().collect()
    if len({r["source"] for r in wanted}) < len(wanted):
        raise ValueError("a source must have one target")
    total_share = sum(r["target_share"] for r in wanted) or 1.0
    goals = {r["source"]: (r["target_share"] / total_share, int(r["max_repeats"])) for r in wanted}
    spark = documents.sparkSession
    picked = documents.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("_body")).where(F.col("doc_id").isNotNull() & F.col("source").isin(list(goals)))
    counted = checkpointed(token_counts(picked, "doc_id", "_body", ["source"], tokenizer).where("tokens > 0").dropDuplicates(["doc_id"]))
    sized = checkpointed(counted.groupBy("source", "tokens").agg(F.count("*").alias("n")))
    sizes = {r["source"]: (r["t"], r["d"]) for r in sized.groupBy("source").agg(F.sum(F.col("tokens") * F.col("n")).alias("t"), F.sum("n").alias("d")).collect()}
    total = float(total_tokens) if total_tokens is not None else _largest_total(sizes, goals)
    solved = solve_rates(sized, goals, total, sizes) if total > 0 else {}
    table = [(s, float(goals[s][1]), None if math.isinf(at) else at, scale, float(min(goals[s][0] * total, sizes[s][0] * goals[s][1]))) for s, (at, scale) in solved.items()]
    rates = spark.createDataFrame(table, "source string, cap double, at double, scale double, goal double")
    rate = F.when(F.col("at").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.exp(F.least(F.lit(50.0), F.col("at") * F.col("tokens") / F.col("scale")))))
    rated = counted.join(_few(rates, len(table)), "source").withColumn("rate", rate)
    base = F.floor("rate")
    # u < fraction gives the extra copy; u - fraction is binned to find each source's threshold near 0.
    u = (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))) - (F.col("rate") - base)
    lined = rated.withColumn("base", base).withColumn("bin", F.when(F.col("rate") > base, F.floor((u + 1) / 2 * BINS)))
    sums = lined.groupBy("source", "bin").agg(F.sum("tokens").alias("t"), F.sum(F.col("tokens") * F.col("base")).alias("b"))
    bins: dict[str, dict] = {}
    for r in sums.collect():  # at most sources x (bins + 1) rows
        own = bins.setdefault(r["source"], {"base": 0, "by": {}})
        own["base"] += r["b"]
        if r["bin"] is not None:
            own["by"][r["bin"]] = r["t"]
    limits = []
    for s, _, _, _, goal in table:
        have, limit = bins.get(s, {"base": 0, "by": {}})["base"], -1
        for b, t in sorted(bins.get(s, {"by": {}})["by"].items()):
            if abs(have + t - goal) > abs(have - goal):
                break
            have, limit = have + t, b
        limits.append((s, limit))
    cut = spark.createDataFrame(limits, "source string, last_bin long")
    extra = F.when(F.col("bin") <= F.col("last_bin"), 1).otherwise(0)
    mixed = lined.join(_few(cut, len(limits)), "source").select("doc_id", "source", "tokens", "rate", (F.col("base") + extra).cast("bigint").alias("copies"))
    done = mixed.groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("available_tokens"), F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"))
    whole = done.agg(F.sum("mixed_tokens").alias("all"))
    wishes = spark.createDataFrame([(s, a, c) for s, (a, c) in goals.items()], "source string, target_share double, max_repeats int")
    report = wishes.join(done, "source", "left").select(
        "source", "target_share", "max_repeats",
        F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("available_tokens", F.lit(0)).alias("available_tokens"), F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"),
        F.coalesce(F.try_divide(F.col("mixed_tokens"), whole.scalar()), F.lit(0.0)).alias("actual_share"),
    )
    return mixed, report
