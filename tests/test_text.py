import pytest
from pyspark.sql import functions as F

from braidlake.functions import text as T
from braidlake.operators import chunking


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first()["y"]


CASES = [
    (T.strip, "  a b \n", "a b"), (T.collapse, " a \n\t b ", "a b"), (T.clean, "== Head  line ==", "Head line"), (T.clean, "a <b>c</b> [1, 2-3] d", "a c d"),
    (T.normal_entity, "  New \n YORK ", "new york"), (T.plain_name, "O'Neil, & Sons", "o neil sons"), (T.slug, "Élan / Vital", "élan_vital"), (T.slug, "!!", "unnamed_entity"),
    (T.signature, "A, b-C!", "abc"), (T.json_object, 'Sure: ```json\n{"a": {"b": 1}}\n```', '{"a": {"b": 1}}'), (T.json_object, "none", None),
    (T.answer_of, "<thinking>t</thinking> <answer> yes </answer>", "yes"), (T.answer_of, "<thinking>t</thinking> yes", "yes"),
    (T.without_citations, "A [1][2, 3] b [Source: f.txt] .\n\n### Sources\n- f", "A b."), (T.readable_source, "/d/notes.txt_0123abcd", "notes.txt"), (T.session_title, "y" * 41, "y" * 40 + "..."),
]


@pytest.mark.parametrize(("column", "value", "wanted"), CASES)
def test_strings(spark, column, value, wanted):
    assert one(spark, value, column("x")) == wanted
    assert one(spark, None, column("x")) is None


def test_tokens_keep_letters_of_all_scripts(spark):
    assert one(spark, "Élan's state-of-the-art x_y 3.5", T.tokens("x")) == ["élan's", "state-of-the-art", "x", "y", "3", "5"]
    assert one(spark, None, T.tokens("x")) == []


def test_counts(spark):
    assert one(spark, "Ada met ada, Adam.", T.mention_count("x", F.lit("ada"))) == 2
    assert one(spark, "aXbXXc", T.substring_count("x", F.lit("X"))) == 3 and one(spark, "a", T.substring_count("x", F.lit(""))) == 0
    assert one(spark, "x [CHUNK-000002] [CHUNK-000001] [CHUNK-000002] [CHUNK-1]", T.cited_chunks("x")) == ["CHUNK-000001", "CHUNK-000002"]


def test_verdicts_and_numbers(spark):
    got = [one(spark, v, T.verdict("x")) for v in ("true", "No", "1", "0.0", "2", "maybe", None)]
    assert got == [1, 0, 1, 0, None, None, None]
    assert one(spark, "2.5", T.number_or("x")) == 2.5 and one(spark, "z", T.number_or("x")) == 1.0


def test_description(spark):
    assert one(spark, ["a", None, " ", "a", "b", "c", "d", "e", "f", "g"], T.description("x"), "array<string>") == "a b c d e f"
    assert one(spark, None, T.description("x"), "array<string>") == ""


def test_blocks(spark):
    df = spark.createDataFrame([(1, " a\r\n b \n \n\n c\n"), (2, " \n\n "), (3, None)], "id int, text string")
    assert [tuple(r) for r in chunking.parse_blocks(df, "id", "text").collect()] == [(1, 0, "a b"), (1, 1, "c")]
    with pytest.raises(ValueError):
        chunking.clean_blocks(df, least=0)


def test_windows(spark):
    df = spark.createDataFrame([("k", " ".join(map(str, range(10)))), ("e", ""), ("n", None), ("s", "one")], "k string, text string")
    got = {(r["k"], r["start"]): r["text"] for r in chunking.chunk_words(df, ["k"], "text", 4, 1).collect()}
    assert got == {("k", 0): "0 1 2 3", ("k", 3): "3 4 5 6", ("k", 6): "6 7 8 9", ("s", 0): "one"}
    ids = sorted((r["id"], r["k"], r["window"]) for r in chunking.chunk_words_numbered(df, ["k"], "text", 4, 1).collect())
    assert ids == [("CHUNK-000000", "k", 0), ("CHUNK-000001", "k", 1), ("CHUNK-000002", "k", 2), ("CHUNK-000003", "s", 0)]
    for size, overlap in ((0, 0), (4, 4), (4, -1)):
        with pytest.raises(ValueError):
            chunking.chunk_words(df, ["k"], "text", size, overlap)


def test_offsets(spark):
    text = "  one  two\nthree 𝒳four five "
    df = spark.createDataFrame([("s", text)], "source string, text string")
    stripped = text.strip()
    for r in chunking.chunk_with_offsets(df, "source", "text", 2, 1).collect():
        assert stripped[r["char_start"] : r["char_end"]] == r["text"] and len(r["text"].split()) == r["token_count"]


def test_token_windows():
    from braidlake.operators.chunking import token_windows

    assert token_windows([1] * 10, 4, 1) == [(0, 4), (3, 7), (6, 10)]
    assert token_windows([9, 1, 1, 9, 1], 3, 1) == [(0, 1), (1, 3), (2, 3), (3, 4), (4, 5)]
    assert token_windows([], 4, 1) == [] and token_windows([1], 1, 0) == [(0, 1)]
    import random

    random.seed(2)
    for _ in range(300):
        counts = [random.randrange(1, 7) for _ in range(random.randrange(1, 40))]
        size = random.randrange(1, 12)
        found = token_windows(counts, size, random.randrange(0, size))
        assert found[0][0] == 0 and found[-1][1] == len(counts) and all(j - i == 1 or sum(counts[i:j]) <= size for i, j in found)
        assert all(a < c <= b for (a, b), (c, d) in zip(found, found[1:]))


def test_byte_pairs_and_prefixes(spark):
    import os

    import pytest

    from braidlake.functions import models
    from braidlake.functions import vectors as V
    from braidlake.operators import chunking

    df = spark.createDataFrame([("a", "one  two\nthree"), ("b", None), ("c", " ")], "k string, t string")
    path = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    if os.path.exists(path):
        rows = chunking.chunk_by_tokens(df, "k", "t", 2, 0, models.BytePairCounter(path)).collect()
        assert [(r["text"], r["char_start"], r["char_end"]) for r in rows] == [("one  two", 0, 8), ("three", 9, 14)]
    with pytest.raises(ValueError):
        chunking.chunk_by_tokens(df, "k", "t", 2, 2)
    both = models.embed_column(models.embed_column(df, "t", "v"), "t", "w", prefix="query: ")
    got = {r["k"]: (r["s"], r["v"] == r["w"]) for r in both.select("k", "v", "w", V.text_similarity("t", "t", "v", "v").alias("s")).collect()}
    assert got["a"][0] > 0.99 and not got["a"][1] and got["b"][0] == got["c"][0] == 1.0
