import datetime as dt

import pytest
from pyspark.sql import functions as F

from braidlake.operators import chat, evaluation

T0 = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize(("word", "stem"), [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("conditional", "condit"), ("adjustment", "adjust"), ("controlling", "control"), ("sky", "sky"), ("oscillators", "oscil")])
def test_porter(word, stem):
    assert evaluation.porter(word) == stem


def test_rouge(spark):
    df = spark.createDataFrame([("the cats sat the", "the the the cat"), ("", "x"), ("x", ""), (None, None)], "answer string, gold string")
    plain = [r[0] for r in df.select(evaluation.rouge1_recall("answer", "gold")).collect()]
    assert plain == [0.5, 0.0, 0.0, 0.0]
    stems = [r["r"] for r in evaluation.with_stemmed_recall(df, "answer", "gold", "r").collect()]
    assert stems == [0.75, 0.0, 0.0, 0.0]


def test_verdict_means(spark):
    df = spark.createDataFrame([(["yes", "0"],), ([],), (["maybe", "1"],), (None,)], "v array<string>")
    assert [r[0] for r in df.select(evaluation.mean_verdict("v")).collect()] == [0.5, None, None, None]
    one = spark.range(1)
    assert one.select(evaluation.factuality(F.lit(3), F.lit(1)), evaluation.factuality(F.lit(0), F.lit(0)), evaluation.relevance(F.lit(1)), evaluation.relevance(F.lit(3))).first() == (0.75, 0.0, 0.5, None)
    with pytest.raises(ValueError):
        evaluation.weighted("a", "b", 0, 0)


def test_means_leave_out_missing_scores(spark):
    df = spark.createDataFrame([("A", "m", 1.0), ("A", "m", float("nan")), ("A", "m", None), ("B", "m", None), (None, "m", 0.5)], "question_type string, metric string, score double")
    got = {r["question_type"]: (r["mean"], r["n"]) for r in evaluation.means_by_type(df).collect()}
    assert got == {"A": (1.0, 1), "B": (None, 0), "Unknown": (0.5, 1)}


def test_report_merge(spark):
    s = "section string, question_type string, metric string, mean double"
    old = spark.createDataFrame([("retrieval", "A", "x", 0.1), ("generation", "A", "x", 0.2), ("generation", "A", "y", 0.3)], s)
    new = spark.createDataFrame([("retrieval", "B", "z", 0.4), ("generation", "A", "x", 0.5)], s)
    got = {tuple(r) for r in evaluation.merged_report(old, new).collect()}
    assert got == {("generation", "A", "y", 0.3), ("retrieval", "B", "z", 0.4), ("generation", "A", "x", 0.5)}


def test_sample_is_stable(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(30)], "id bigint, g string")
    a = {tuple(r) for r in evaluation.stratified_sample(df, "id", ["g"], 4).collect()}
    assert a == {tuple(r) for r in evaluation.stratified_sample(df.repartition(3), "id", ["g"], 4).collect()} and len(a) == 8


def test_history(spark):
    rows = [(i, 1, r, c, T0 + dt.timedelta(minutes=t)) for i, r, c, t in ((1, "user", "a", 5), (2, "Assistant ", "b", 5), (3, "system", "s", 6), (4, "user", " ", 7), (5, "user", "late", 1), (6, None, "x", 8))]
    df = spark.createDataFrame(rows + rows[:1], "id bigint, session_id bigint, role string, content string, created_at timestamp_ntz")
    assert [(r["turn"], r["id"]) for r in chat.recent_history(df, 2).orderBy("turn").collect()] == [(1, 1), (2, 2)]
    assert chat.titles(df).first()["title"] == "late"


def test_sources_and_orphans(spark):
    answers = spark.createDataFrame([(1, "A [1]."), (2, "B")], "query_id int, answer string")
    hits = spark.createDataFrame([(1, 1, "d/x.txt_0123456789"), (1, 2, "X.TXT"), (1, 3, "y.txt")], "query_id int, rank int, source string")
    got = {r["query_id"]: r["answer"] for r in chat.with_sources(answers, hits).collect()}
    assert got == {1: "A.\n\n### Sources\n- x.txt\n- y.txt", 2: "B"}
    sessions = spark.createDataFrame([(1, 7), (2, 8)], "id bigint, user_id bigint")
    rows = spark.createDataFrame([(1,), (3,), (3,), (None,)], "session_id bigint")
    assert [r[0] for r in chat.orphans(rows, sessions).collect()] == [3]
    kept, _, _ = chat.delete_session(sessions, rows, rows, 1, 8)
    assert kept.count() == 2  # another user's session stays
