import random
from collections import Counter
from itertools import combinations

import pytest

from braidlake.llm.cooccurrence import cooccurrence


def brute(rows, least, lift):
    baskets = {}
    for item, b, c in rows:
        if None not in (item, b, c):
            baskets.setdefault((b, c), set()).add(item)
    n, pairs = Counter(), Counter()
    for own in baskets.values():
        n.update(own)
        pairs.update(combinations(sorted(own), 2))
    return {(a, b, k, n[a], n[b]) for (a, b), k in pairs.items() if k >= least and k * len(baskets) >= lift * n[a] * n[b]}


@pytest.mark.parametrize("long_basket", [4000, 6])
def test_brute_force(spark, long_basket):
    random.seed(1)
    rows = [(f"i{random.randrange(25)}", random.choice("xy"), random.randrange(12)) for _ in range(400)]
    rows += [(f"i{k}", "hot", b) for k in range(25) for b in (1, 2, 3)] + [(None, "x", 1), ("i1", None, 1), ("i1", "x", None)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "node string, s string, c int, weight string")
    got = {tuple(r[:5]) for r in cooccurrence(df, "node", ["s", "c"], 3, 0.9, long_basket, 4).collect()}
    assert got == brute(rows, 3, 0.9) and got


def test_measures_and_empty(spark):
    df = spark.createDataFrame([("a", 1), ("b", 1), ("a", 2), ("b", 2), ("c", 3), ("a", 4)], "i string, b int")
    row = cooccurrence(df, "i", ["b"], 2).first()
    assert (row["n_ab"], row["n"], row["lift"]) == (2, 4, 2 * 4 / (3 * 2)) and row["conviction"] == pytest.approx((1 - 2 / 4) / (1 - 2 / 3))
    assert cooccurrence(df.limit(0), "i", ["b"]).count() == 0
