"""Sampling of questions, metrics of answers and means by question type."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidlake.functions import text as T

# Metrics by question type.
METRICS = {
    "Fact Retrieval": ("rouge_score", "answer_correctness"),
    "Complex Reasoning": ("answer_correctness", "coverage_score", "faithfulness"),
    "Contextual Summarize": ("rouge_score", "answer_correctness", "coverage_score", "faithfulness"),
    "Creative Generation": ("answer_correctness", "coverage_score", "faithfulness"),
}


def stratified_sample(df: DataFrame, key: str, strata: list[str], k: int, seed: int = 42) -> DataFrame:
    """At most k rows of each stratum, in the order of a hash of the key and the seed."""
    order = Window.partitionBy(*strata).orderBy(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))), key)
    return df.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")


def rouge_tokens(x) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(""))), "[^a-z0-9]+"), lambda t: t != "")


def multiset_overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays, within the row."""
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda s, t: s + F.least(F.size(F.filter(a, lambda x: x == t)), F.size(F.filter(b, lambda x: x == t))))


def rouge1_recall(answer, gold) -> Column:
    """Share of the gold answer's tokens found in the answer; 0 where a side has none."""
    return _recall(rouge_tokens(answer), rouge_tokens(gold))


def with_stemmed_recall(df: DataFrame, answer: str, gold: str, into: str) -> DataFrame:
    """Adds the recall of stemmed tokens; all other columns stay."""
    stems = df.withColumn("_answer_stems", stemmed(rouge_tokens(answer))).withColumn("_gold_stems", stemmed(rouge_tokens(gold)))
    return stems.withColumn(into, _recall(F.col("_answer_stems"), F.col("_gold_stems"))).drop("_answer_stems", "_gold_stems")


def _recall(a: Column, g: Column) -> Column:
    return F.when(F.size(g) > 0, multiset_overlap(g, a) / F.size(g)).otherwise(0.0)


def _measure(w: str) -> int:
    form = "".join("v" if c in "aeiou" or c == "y" and i and w[i - 1] not in "aeiou" else "c" for i, c in enumerate(w))
    return sum(form[i : i + 2] == "vc" for i in range(len(form)))


def _vowel(w: str) -> bool:
    return any(c in "aeiou" or c == "y" and i > 0 for i, c in enumerate(w))


def _cvc(w: str) -> bool:
    v = lambda i: w[i] in "aeiou" or w[i] == "y" and i > 0 and w[i - 1] not in "aeiou"
    return len(w) >= 3 and not v(len(w) - 1) and v(len(w) - 2) and not v(len(w) - 3) and w[-1] not in "wxy"


# Suffix tables of the stemmer published by Porter in 1980.
_STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
_STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


def porter(word: str) -> str:
    """The stem of a lower-case English word; words of up to three letters stay."""
    w = word
    if len(w) <= 3:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and _vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in "aeioulsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and _vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        pairs = [p.split(":") for p in table.split(" ")]
        for end, new in sorted(pairs, key=lambda p: -len(p[0])):
            if w.endswith(end):
                if _measure(w[: -len(end)]) > 0:
                    w = w[: -len(end)] + new
                break
    for end in sorted(_STEP4.split(" "), key=lambda e: -len(e)):
        if w.endswith(end):
            stem = w[: -len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _cvc(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def stemmed(tokens: Column) -> Column:
    @F.pandas_udf("array<string>")
    def run(lists: pd.Series) -> pd.Series:
        known: dict[str, str] = {}
        return pd.Series([[known.get(t) or known.setdefault(t, porter(t)) for t in (x if x is not None else [])] for x in lists])

    return run(tokens)


def mean_verdict(xs) -> Column:
    """Mean of an array of 0/1 verdicts; null for an empty array or where a verdict can't be read."""
    array = F.col(xs) if isinstance(xs, str) else xs
    read = F.transform(array, T.verdict)
    return F.when((F.size(array) > 0) & ~F.exists(read, lambda v: v.isNull()), F.aggregate(read, F.lit(0.0), lambda s, v: s + v) / F.size(array))


def factuality(tp, fn) -> Column:
    """TP / (TP + FN), 0 without either; false positives don't count."""
    t, f = (F.col(x) if isinstance(x, str) else x for x in (tp, fn))
    return F.when(t + f > 0, t / (t + f)).otherwise(0.0)


def relevance(rating) -> Column:
    r = F.col(rating) if isinstance(rating, str) else rating
    return F.when(r.isin(0, 1, 2), r / 2.0)


def weighted(a, b, wa: float = 0.5, wb: float = 0.5) -> Column:
    """Weighted mean of two scores; null if one is null."""
    if wa < 0 or wb < 0 or wa + wb == 0:
        raise ValueError("weights must not be negative and not both 0")
    x, y = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return (wa * x + wb * y) / (wa + wb)


def metric_table(spark) -> DataFrame:
    """(question_type, metric): which metrics hold for which type."""
    return spark.createDataFrame([(t, m) for t, ms in METRICS.items() for m in ms], "question_type string, metric string")


def means_by_type(scores: DataFrame) -> DataFrame:
    """(question_type, metric, mean, n): NaN and null scores are left out of means; a null type is Unknown."""
    value = F.when(~F.isnan("score"), F.col("score"))
    return scores.groupBy(F.coalesce("question_type", F.lit("Unknown")).alias("question_type"), "metric").agg(F.round(F.avg(value), 6).alias("mean"), F.count(value).alias("n"))


def merged_report(old: DataFrame, new: DataFrame) -> DataFrame:
    """(section, question_type, metric, mean): new retrieval scores replace the section, new generation scores replace
    single metrics."""
    keys = ["section", "question_type", "metric"]
    replaced = new.where("section = 'retrieval'").select("section").distinct()
    kept = old.join(replaced, "section", "left_anti").join(new.select(*keys), keys, "left_anti")
    return kept.select(*keys, "mean").unionByName(new.select(*keys, "mean"))
