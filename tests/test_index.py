import json

import pytest
from pyspark.sql import functions as F

from braidlake.plans import ask, index
from braidlake.runtime import numbered
from braidlake.sources import files
from braidlake.sources.store import Store, replaced_by_source

TEXTS = [
    ("one", "Ada Byron met Bert Cox at the Iron College.\n\nBert Cox left Iron College in winter. The otters swim in the river."),
    ("two", "Cleo Dunn wrote to Ada Byron about copper kettles.\n\nCopper kettles are made in the Salt Valley by Cleo Dunn."),
    ("three", "Nothing is known about the price of kettles. Weather was fair in Salt Valley."),
]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    own = index.Index(spark, str(tmp_path_factory.mktemp("index")))
    counts = own.ingest(spark.createDataFrame(TEXTS, "source string, text string"), 12, 3)
    return own, counts


def test_ingest_and_replace(spark, built):
    own, counts = built
    assert counts["chunks"] > 3 and counts["nodes"] >= 4 and counts["communities"] >= 1
    again = own.ingest(spark.createDataFrame(TEXTS[:1], "source string, text string"), 12, 3)
    same = ("chunks", "nodes", "edges", "communities")
    assert {k: again[k] for k in same} == {k: counts[k] for k in same} and again["texts"] == 0 and counts["raw_blocks"] == 5  # unchanged texts are skipped
    own.ingest(spark.createDataFrame([("three", "Gus Hall sells kettles.")], "source string, text string"), 12, 3)
    assert own.store.load("chunks").where("source = 'three'").count() == 1
    assert own.store.load("nodes").where("name = 'gus hall'").count() == 1


def tables(own):
    names = ("chunks", "chunk_vectors", "nodes", "edges", "entity_chunks", "community_members", "community_summaries")
    return {n: own.store.load(n) for n in names}


def test_retrieval(spark, built):
    own, _ = built
    questions = spark.createDataFrame([(1, "Who makes copper kettles?"), (2, "Where did Bert Cox go?"), (3, " ")], "query_id bigint, question string")
    retriever = ask.Retriever(tables(own))
    for mode in ("local", "global", "hybrid"):
        hits = retriever.hybrid(questions, mode).collect()
        assert {r["query_id"] for r in hits} <= {1, 2} and all(r["rank"] <= 5 for r in hits)
    best = retriever.hybrid(questions).where("query_id = 1 and rank = 1").first()
    assert "kettles" in best["text"].lower()
    with pytest.raises(ValueError):
        retriever.hybrid(questions, "other")


def test_explorer(spark):
    chunks = spark.createDataFrame([(f"CHUNK-00000{i}", f"s{i}", None, t) for i, t in enumerate(["Ada Byron met Bert Cox at Iron College.", "Bert Cox left Iron College in winter.", "Copper kettles shine.", "Cleo Dunn makes copper kettles."])], "chunk_id string, source string, page int, text string")
    entities = spark.createDataFrame([("ada", "Ada Byron", "PERSON", "met Bert"), ("bert", "Bert Cox", "PERSON", ""), ("cleo", "Cleo Dunn", None, None)], "id string, name string, type string, description string")
    links = spark.createDataFrame([("ada", "bert"), ("bert", "bert")], "src string, dst string")
    held = spark.createDataFrame([("ada", 0, "CHUNK-000000"), ("bert", 0, "CHUNK-000000"), ("bert", 1, "CHUNK-000001"), ("cleo", 0, "CHUNK-000003"), ("cleo", 1, "CHUNK-999999")], "id string, pos int, chunk_id string")
    reports = spark.createDataFrame([(0, "Ada Byron and Bert Cox")], "community_id bigint, text string")
    own = ask.Explorer({"chunks": chunks, "entities": entities, "links": links, "entity_chunks": held, "reports": reports})
    questions = spark.createDataFrame([(1, "Where did Ada Byron meet Bert Cox?"), (2, "  "), (3, None)], "query_id bigint, question string")
    found = own.search(questions, depth=2, followups=2)
    trace = [r.asDict() for r in found["trace"].collect()]
    assert {r["query_id"] for r in trace} == {"1"} and {r["depth"] for r in trace} == {0, 1, 2} or {r["depth"] for r in trace} == {0, 1}
    asked = [r["question"].lower() for r in trace]
    assert len(asked) == len(set(asked)) and all(len([r for r in trace if r["depth"] == d]) <= 2 for d in (1, 2))
    first = next(r for r in trace if r["depth"] == 0)
    assert set(first["chunk_ids"]) == {f"CHUNK-00000{i}" for i in range(4)} and "[CHUNK-00000" in first["answer"]
    answer = found["answers"].first()["answer"]
    cited = {r["chunk_id"]: r["source"] for r in found["sources"].collect()}
    assert cited and all(f"[{c}]" in answer and s == "s" + c[-1] for c, s in cited.items())
    # without hops, only chunks of the seeds and the nearest ones count
    near = ask.Explorer(own.t, hops=0).step(questions.where("query_id = 1").select(F.col("query_id").cast("string").alias("query_id"), F.col("question").alias("root"), "question"), 5, 2)[0]
    assert near.count() == 4


def test_unknown_citations_drop_out(spark):
    answered = spark.createDataFrame([("a", "see [CHUNK-000001], [CHUNK-000009] and [CHUNK-1]"), ("b", None)], "query_id string, answer string")
    chunks = spark.createDataFrame([("CHUNK-000001", "s", 3)], "chunk_id string, source string, page int")
    assert [tuple(r) for r in ask.cited_sources(answered, chunks).collect()] == [("a", "CHUNK-000001", "s", 3)]


def test_converse(spark, built):
    own, _ = built
    messages = spark.createDataFrame([(1, 7, "user", "Tell me of copper kettles", None), (2, 7, "assistant", "They are made.", None)], "id bigint, session_id bigint, role string, content string, created_at timestamp_ntz")
    sessions = spark.createDataFrame([(7, 1), (8, 2)], "id bigint, user_id bigint")
    asked = spark.createDataFrame([(1, 7, 1, "Who makes copper kettles? "), (2, 7, 2, "not mine"), (3, 8, 2, " ")], "query_id bigint, session_id bigint, user_id bigint, question string")

    class Rewriter:
        def generate(self, prompts):
            assert all("copper" in p for p in prompts)
            return ["Who makes copper kettles in Salt Valley?"] * len(prompts)

    for mode in ("hybrid", "local"):
        rows = ask.converse(ask.Retriever(tables(own)), asked, messages, sessions, mode, rewriter=Rewriter()).collect()
        assert [r["query_id"] for r in rows] == [1]
        meta = rows[0]["metadata"]
        assert meta["retrieval_query"].endswith("Valley?") and meta["num_hits"] > 0 and meta["mode"] == mode and "### Sources" in rows[0]["answer"]
        assert any(e.endswith("salt valley") for e in meta["entities"]) and meta["entities"] == sorted(set(meta["entities"]))
    empty = {k: v.limit(0) for k, v in tables(own).items()}
    none = ask.converse(ask.Retriever(empty), asked, messages, sessions, "local").collect()
    assert none[0]["answer"] == ask.NO_CONTEXT


def test_segments(spark, tmp_path):
    own = index.Index(spark, str(tmp_path / "i"))
    for bad in (("1", "t", " "), ("../x", "t", "text")):
        with pytest.raises(ValueError):
            own.ingest_segment(*bad)
    own.ingest_segment("s-1", "notes/Ada.txt", "Ada Byron met Bert Cox. Bert Cox left.")
    assert own.store.load("chunks").first()["source"].startswith("Ada.txt_")


def test_predictions_and_reports(spark, tmp_path):
    rows = spark.createDataFrame([("1", "q", "a\nb"), ("2", None, "c")], "id string, question string, generated_answer string")
    files.save_predictions(rows, str(tmp_path / "p"))
    got = {r["id"]: (r["question"], r["generated_answer"], r["error"]) for r in files.read_predictions(spark, str(tmp_path / "p")).collect()}
    assert got == {"1": ("q", "a\nb", None), "2": (None, "c", None)} and files.read_predictions(spark, str(tmp_path / "missing")).count() == 0
    (tmp_path / "list.json").write_text(json.dumps([{"id": "3", "question": "x"}, {"id": "4", "error": "e"}]))
    assert files.read_predictions(spark, str(tmp_path / "list.json"), array=True).count() == 2
    schema = "section string, question_type string, metric string, mean double"
    path = str(tmp_path / "report")
    files.update_report(spark, path, spark.createDataFrame([("generation", "Fact Retrieval", "rouge_score", 0.5), ("generation", "Fact Retrieval", "x", 0.1), ("retrieval", "A", "m", 0.2)], schema))
    files.update_report(spark, path, spark.createDataFrame([("generation", "Fact Retrieval", "rouge_score", 0.75), ("retrieval", "B", "n", 1.0)], schema))
    assert {tuple(r) for r in files.read_report(spark, path).collect()} == {("generation", "Fact Retrieval", "rouge_score", 0.75), ("generation", "Fact Retrieval", "x", 0.1), ("retrieval", "B", "n", 1.0)}


def test_context_and_answers(spark):
    questions = spark.createDataFrame([(1, "q?"), (2, "r?")], "query_id int, question string")
    hits = spark.createDataFrame([(1, 2, None, "second"), (1, 1, "s", " first ")], "query_id int, rank int, source string, text string")
    notes = spark.createDataFrame([(1, 1, "n: m")], "query_id int, rank int, summary string")
    got = {r["query_id"]: r["context"] for r in ask.format_context(questions, hits, notes).collect()}
    assert got[2] == "No relevant content found."
    assert got[1] == '## Knowledge Graph Community Summaries\n\n- n: m\n\n---\n\n<source id="1" name="s">\nfirst\n</source>\n\n---\n\n<source id="2" name="unknown">\nsecond\n</source>'
    contexts = spark.createDataFrame([(1, "A b. C d. E f.")], "query_id int, context string")
    assert {r["query_id"]: r["answer"] for r in ask.answers(questions, contexts).collect()}[1] == "A b. C d."


def test_readers(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.txt").write_bytes(b"caf\xff text")
    (tmp_path / "b.md").write_text("md")
    (tmp_path / "c.bin").write_text("no")
    (tmp_path / "d.txt").write_text(" \n")
    got = {r["source"]: r["text"] for r in files.read_texts(spark, str(tmp_path)).collect()}
    assert got == {"a": "caf� text", "b": "md"}
    (tmp_path / "e.json").write_text(json.dumps({"corpus_name": "c", "context": "x", "questions": [{"id": "1", "question": "q"}]}))
    (tmp_path / "f.json").write_text(json.dumps({"corpus_name": " ", "context": "x", "questions": [{"id": "2"}]}))
    corpora, questions = files.read_eval_set(spark, [str(tmp_path / "e.json"), str(tmp_path / "f.json")])
    assert corpora.count() == 1 and [r["id"] for r in questions.collect()] == ["1"]


def test_replace_and_numbers(spark, tmp_path):
    old, new = spark.createDataFrame([("a", 1), ("b", 2)], "source string, n int"), spark.createDataFrame([("b", 3), ("b", 4)], "source string, n int")
    assert sorted(tuple(r) for r in replaced_by_source(old, new).collect()) == [("a", 1), ("b", 3), ("b", 4)]
    store = Store(spark, str(tmp_path))
    store.replace_sources("t", old)
    store.replace_sources("t", new)
    assert sorted((r["source"], r["n"]) for r in store.load("t").collect()) == [("a", 1), ("b", 3), ("b", 4)]
    got = sorted((r["id"], r["k"]) for r in numbered(spark.range(500).repartition(7), ["id"], "k").collect())
    assert got == [(i, i) for i in range(500)]


def test_streams(spark, tmp_path):
    from braidlake.streaming.ingest import event_counts, ingest_stream, read_events

    data = tmp_path / "in"
    spark.createDataFrame(TEXTS[:2], "source string, text string").write.parquet(str(data))
    own = index.Index(spark, str(tmp_path / "index"))
    ingest_stream(spark.readStream.schema("source string, text string").parquet(str(data)), own, str(tmp_path / "cp")).awaitTermination(120)
    assert own.store.load("chunks").select("source").distinct().count() == 2
    events = spark.sql("select timestamp_ntz '2024-01-01 00:10:00' as ts, 'click' as event_type, 2.0D as value")
    events.union(events).write.parquet(str(tmp_path / "events"))
    stream = event_counts(read_events(spark, str(tmp_path / "events"), events.schema))
    query = stream.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [(r["n"], r["total"]) for r in spark.table("counted").collect()] == [(2, 4.0)]
