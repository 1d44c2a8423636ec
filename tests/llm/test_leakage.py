import random
import re

import numpy as np
import pytest

from braidlake.llm.leakage import MASKS, leaks, longest_overlap, seeds


def brute(docs, items, k):
    w = lambda t: re.findall(r"[^\W_]+", t.lower())
    runs = lambda t: {tuple(w(t)[i : i + k]) for i in range(len(w(t)) - k + 1)}
    return {(d, i, s) for d, t, _ in docs if t for i, *ps in items for s, p in enumerate(ps) if p and runs(t) & runs(p)}


@pytest.mark.parametrize("bound", [2_000_000, 0])
def test_brute_force(spark, bound):
    random.seed(7)
    word = lambda: random.choice("abcdefghijklmnopqrstuvwxyz") * random.randrange(1, 4)
    items = [(i, " ".join(word() for _ in range(40)), " ".join(word() for _ in range(15))) for i in range(12)] + [(99, None, "too short"), (100, "", None)]
    docs = []
    for d in range(60):
        body = [word() for _ in range(50)]
        source = random.choice(items[:12])[random.randrange(1, 3)].split()
        n = random.randrange(8, 16)
        at = random.randrange(max(1, len(source) - n))
        body[20:20] = [x.upper() + random.choice(["", ",", "\n", " *", "_"]) for x in source[at : at + n]]
        docs.append((d, " ".join(body), "x"))
    docs += [(1000, None, "x"), (1001, "", "x"), docs[0]]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, seed string")
    tests = spark.createDataFrame(items, "item_id bigint, evidence string, answer string")
    got = {(r["doc_id"], r["item_id"], r["side"]) for r in leaks(df, "doc_id", "text", tests, "item_id", ["evidence", "answer"], seed_bound=bound).collect()}
    assert got == brute(docs, items, 12) and got
    assert leaks(df.limit(0), "doc_id", "text", tests, "item_id", ["evidence"]).count() == 0
    assert leaks(df, "doc_id", "text", tests.limit(0), "item_id", ["evidence"], seed_bound=bound).count() == 0


def test_substitutions():
    a = np.arange(30, dtype=np.uint64)
    b = a.copy()
    b[15] = 999
    assert longest_overlap(a, b, 0, 0) == (15, 0) and longest_overlap(a, b, 0, 1) == (30, 1) and longest_overlap(a, b, 25, 1) == (0, 0)
    assert longest_overlap(a[3:], b, 3, 0) == (14, 0) and longest_overlap(a, b[3:], -3, 1) == (27, 1)
    # a word under a 0 of the mask may differ
    for mask in MASKS:
        x, y = np.arange(12, dtype=np.uint64), np.arange(12, dtype=np.uint64)
        y[mask.index("0")] = 77
        assert seeds(x, mask)[0] == seeds(y, mask)[0]


def test_both_ways_agree(spark):
    """Broadcast and joined seeds give the same overlaps, those of a brute-force search, with up to two substitutions."""
    random.seed(9)
    items = [(i, " ".join(random.choice("abcdefgh") * random.randrange(1, 5) for _ in range(30))) for i in range(6)]
    docs = []
    for d in range(40):
        part = random.choice(items)[1].split()[random.randrange(8) :][: random.randrange(12, 24)]
        for _ in range(random.randrange(3)):
            part[random.randrange(len(part))] = "zz"
        filler = [random.choice("abcdefgh") * random.randrange(1, 5) for _ in range(20)]
        docs.append((d, " ".join(filler[:10] + part + filler[10:])))
    docs += [(99, "a <b href='" + "x" * 900 + "'>" + items[0][1] + "</b>"), (100, "a " * 3000)]
    df, tests = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([*items, (7, "a " * 300)], "item_id bigint, evidence string")

    def best(t, p, k):
        x, y = re.findall(r"[^\W_]+", p.lower()), re.findall(r"[^\W_]+", re.sub(r"<[^>]*>", " ", t).lower())
        tops = [longest_overlap(np.array([hash(w) for w in x]), np.array([hash(w) for w in y]), d, k) for d in range(-len(x), len(y))]
        return max(tops, key=lambda v: (v[0], -v[1]))

    for k in (0, 1):
        rows = [sorted(tuple(r) for r in leaks(df, "doc_id", "text", tests, "item_id", ["evidence"], substitutions=k, seed_bound=b).collect()) for b in (2_000_000, 0)]
        assert rows[0] == rows[1]
        want = sorted((d, i, 0, *best(t, p, k)) for d, t in docs for i, p in items if best(t, p, k)[0] >= 12)
        assert [r for r in rows[0] if r[1] != 7] == want and (100, 7, 0, 300, 0) in rows[0]


def test_one_substitution_at_any_position(spark):
    words = [f"word{i}" for i in range(12)]
    texts = [(k, " ".join(["before", *words[:k], "other", *words[k + 1 :], "after"])) for k in range(1, 11)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    tests = spark.createDataFrame([("i", " ".join(words))], "item_id string, evidence string")
    for bound in (2_000_000, 0):
        found = leaks(docs, "doc_id", "text", tests, "item_id", ["evidence"], substitutions=1, seed_bound=bound)
        assert {r["doc_id"] for r in found.collect()} == set(range(1, 11))
