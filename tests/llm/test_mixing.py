import math
import random

import pytest

from braidlake.llm.mixing import mixture


def test_targets_are_met(spark):
    random.seed(8)
    docs = [(i, "word " * random.randrange(5, 60), random.choices("abc", [70, 25, 5])[0], "x") for i in range(3000)]
    docs += [(9001, None, "a", "x"), (9002, "word", None, "x"), (None, "word", "a", "x"), (9003, "word", "other", "x"), docs[0]]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string, tokens string")
    goals = spark.createDataFrame([("a", 0.4, 1), ("b", 0.4, 2), ("c", 0.2, 3), ("gone", 0.0, 1), (None, 0.3, 1)], "source string, target_share double, max_repeats int")
    mixed, report = mixture(df, "doc_id", "text", "source", goals)
    rows = mixed.collect()
    caps = {"a": 1, "b": 2, "c": 3}
    assert len(rows) == 3000 and all(0 <= r["copies"] <= caps[r["source"]] and r["rate"] <= caps[r["source"]] + 1e-9 for r in rows)
    shares = {r["source"]: r for r in report.collect()}
    assert set(shares) == set(caps)
    for s, want in (("a", 0.4), ("b", 0.4), ("c", 0.2)):
        assert shares[s]["actual_share"] == pytest.approx(want, abs=0.004)
    # the source that binds is used up; within a source rates are exp(lambda x tokens)
    full = [s for s in caps if shares[s]["mixed_tokens"] == caps[s] * shares[s]["available_tokens"]]
    assert len(full) == 1
    tilted = [r for r in rows if r["source"] not in full and r["rate"] < caps[r["source"]]]
    for s in {r["source"] for r in tilted}:
        slopes = [math.log(r["rate"]) / r["tokens"] for r in tilted if r["source"] == s]
        assert max(slopes) - min(slopes) < 1e-9


def test_fixed_total_reports_shortfall(spark):
    df = spark.createDataFrame([(i, "some words here", "ab"[i % 2]) for i in range(40)], "doc_id bigint, text string, source string")
    goals = spark.createDataFrame([("a", 0.5, 1), ("b", 0.25, 2), ("missing", 0.25, 4)], "source string, target_share double, max_repeats int")
    _, report = mixture(df, "doc_id", "text", "source", goals, total_tokens=10_000)
    got = {r["source"]: (r["documents"], r["mixed_tokens"], round(r["actual_share"], 3)) for r in report.collect()}
    assert got["missing"] == (0, 0, 0.0) and got["a"][0] == 20 and got["b"][1] == 2 * got["a"][1]


def test_two_targets_are_an_error(spark):
    df = spark.createDataFrame([(1, "word", "a")], "doc_id bigint, text string, source string")
    goals = spark.createDataFrame([("a", 0.5, 1), ("a", 0.4, 1), ("b", 0.1, 1)], "source string, target_share double, max_repeats int")
    with pytest.raises(ValueError):
        mixture(df, "doc_id", "text", "source", goals)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, source string")
    goals = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    mixed, report = mixture(df, "doc_id", "text", "source", goals)
    assert mixed.count() == 0 and report.first()["actual_share"] == 0.0
    assert mixture(df, "doc_id", "text", "source", goals.limit(0))[1].count() == 0


def test_source_without_tokens_leaves_the_others(spark):
    docs = [(i, "some words here", "ab"[i % 2]) for i in range(400)] + [(900, None, "void"), (901, "", "void")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    goals = spark.createDataFrame([("a", 0.4, 1), ("b", 0.2, 1), ("void", 0.2, 3), ("gone", 0.2, 2)], "source string, target_share double, max_repeats int")
    mixed, report = mixture(df, "doc_id", "text", "source", goals)
    assert mixed.count() == 400
    got = {r["source"]: (r["documents"], r["actual_share"]) for r in report.collect()}
    assert got["void"] == got["gone"] == (0, 0.0)
    assert got["a"][1] == pytest.approx(2 / 3, abs=0.01) and got["b"][1] == pytest.approx(1 / 3, abs=0.01)
