import random

from braidlake.llm.splitting import pieces, pieces_of_long_texts

WHITE = " \t\r\n"


def brute(text, limit=1200, least=600, overlap=120):
    starts = {}
    for i in range(1, len(text)):
        if text[i] not in WHITE and text[i - 1] in WHITE:
            j = i
            while j and text[j - 1] in WHITE:
                j -= 1
            feeds = text[j:i].count("\n")
            starts[i] = 3 if feeds > 1 else 2 if feeds else 1 if j and text[j - 1] in ".!?" else 0
    out, s = [], 0
    while len(text) - s > limit:
        inside = [(k, e) for e, k in starts.items() if s + least < e <= s + limit]
        e = max(inside)[1] if inside else s + limit
        out.append((s, e))
        s = min((p for p in starts if e - overlap <= p < e), default=e - overlap)
    return [*out, (s, len(text))]


def test_brute_force():
    random.seed(2)
    for _ in range(150):
        parts = [random.choice(["word", "x" * random.randrange(1, 90), "end.", "é𝒳", "?"]) + random.choice([" ", " ", " ", "\n", "\r\n", "\n\n", "\n \n", "\t"]) for _ in range(random.randrange(1, 400))]
        text = "".join(parts)
        assert pieces(text) == brute(text)
        assert pieces(text, 200, 100, 30) == brute(text, 200, 100, 30)


def test_unbroken_and_cover():
    text = "a" * 5000
    got = pieces(text)
    assert got == brute(text) and got[0] == (0, 1200) and all(e - s <= 1200 for s, e in got)
    assert all(b[0] < a[1] for a, b in zip(got, got[1:], strict=False)) and got[-1][1] == 5000


def test_table(spark):
    df = spark.createDataFrame([(1, "w " * 1500, 0), (1, "w " * 1500, 0), (2, None, 0), (3, "", 0), (4, "short", 0)], "id bigint, text string, char_start int")
    got = sorted((r["id"], r["char_start"], r["char_end"]) for r in pieces_of_long_texts(df, "id", "text").collect())
    assert got == [(1, a, b) for a, b in brute("w " * 1500)]
    assert pieces_of_long_texts(df.limit(0), "id", "text").count() == 0
