import random
import re

import numpy as np
import pytest

from braidlake.llm.neardup import RunHashes, Sketches, compare_tile, least_common, near_duplicate_groups, near_duplicate_pairs, prefix_size, sketch


def sets_of(texts, n):
    out = {}
    for k, t in texts:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        s = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        if k is not None and s:
            out[k] = s
    return out


def brute(texts, n, t):
    s = sets_of(texts, n)
    keys = sorted(s)
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(s[a] & s[b]) >= t * len(s[a] | s[b])}


def corpus():
    random.seed(3)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = []
    for g in range(25):
        base = [random.choice(vocabulary) for _ in range(random.randrange(5, 90))]
        for c in range(4):
            own = list(base)
            for _ in range(random.randrange(0, 5)):
                own[random.randrange(len(own))] = random.choice(vocabulary)
            texts.append((f"{g}_{c}", " ".join(own)))
    # one template holds a third of all records
    texts += [(f"t_{i}", "the same long template text of many records number " + str(i % 7) + " with a tail that never changes at all") for i in range(50)]
    return [*texts, ("n", None), ("e", ""), ("two", "two words"), (None, "a b c d e f"), texts[0]]


@pytest.mark.parametrize(("n", "t", "tile", "meet"), [(3, 0.6, 2000, 256), (3, 0.6, 7, 0), (3, 0.6, 7, 5), (5, 0.8, 2000, 256)])
def test_brute_force(spark, n, t, tile, meet, monkeypatch):
    from braidlake.llm import neardup

    monkeypatch.setattr(neardup.near_duplicates, "__defaults__", (5, 0.8, None, tile, meet))
    texts = corpus()
    df = spark.createDataFrame([(k, x, "c") for k, x in texts], "key string, text string, runs string")
    got = [tuple(r) for r in near_duplicate_pairs(df, "key", "text", n, t).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(texts, n, t)


def test_sketch_bound_and_tiles():
    random.seed(4)
    hashes = RunHashes(3)
    sets = [hashes(" ".join(random.choice("abcdefgh") + str(random.randrange(3)) for _ in range(n))) for n in [40] * 25 + [400, 420, 900, 1500, 4000]]
    sets.sort(key=len)
    marks, sizes = Sketches([sketch(s) for s in sets]), np.array([len(s) for s in sets])
    x, y = (v.ravel() for v in np.indices((30, 30)))
    assert all(d <= len(np.setxor1d(sets[i], sets[j])) for d, i, j in zip(marks.apart(x, y), x, y, strict=True))
    i, j = compare_tile(sizes, marks, np.arange(30), np.arange(30), 0.6, step=4)
    near = set(zip(i.tolist(), j.tolist(), strict=True))
    assert all((x, y) in near for x, a in enumerate(sets) for y, b in enumerate(sets) if len(np.intersect1d(a, b)) >= 0.6 * len(np.union1d(a, b)))


def test_least_common_loses_nothing():
    """However the order of runs, similar sets share at least that many runs of their prefixes."""
    random.seed(11)
    for _ in range(400):
        n = random.randrange(1, 60)
        a = set(random.sample(range(200), n))
        b = (set(a) - set(random.sample(sorted(a), random.randrange(0, len(a) // 3 + 1)))) | set(random.sample(range(200), random.randrange(0, 20)))
        if not b or len(a & b) < 0.6 * len(a | b):
            continue
        x, y = (np.int64(len(s)) for s in (a, b))
        heads = [set(sorted(s)[: int(prefix_size(k, 0.6))]) for s, k in ((a, x), (b, y))]
        assert len(heads[0] & heads[1]) >= least_common(x, y, 0.6)


def test_scopes_are_apart(spark):
    df = spark.createDataFrame([("a", "x y z u v w", "1"), ("b", "x y z u v w", "1"), ("c", "x y z u v w", "2"), ("d", "x y z u v w", None)], "key string, text string, s string")
    assert [tuple(r) for r in near_duplicate_pairs(df, "key", "text", 3, 0.6, "s").collect()] == [("a", "b")]


def test_groups_and_empty(spark):
    df = spark.createDataFrame([("a", "x y z u v w"), ("b", "x y z u v w"), ("c", "x y z u v w q"), ("d", "other words stand here now")], "key string, text string")
    got = {r["key"]: (r["group_id"], r["group_size"]) for r in near_duplicate_groups(df, "key", "text", 3, 0.6).collect()}
    assert got == {"a": ("a", 3), "b": ("a", 3), "c": ("a", 3), "d": ("d", 1)}
    assert near_duplicate_pairs(df.limit(0), "key", "text").count() == 0


def test_little_stays_on_disk(spark):
    """Neither sets, which are larger than their texts, nor what steps have shuffled stay on disk."""
    import os

    from braidlake.llm.neardup import near_duplicates

    def used():
        folder = (spark.sparkContext.getCheckpointDir() or "").removeprefix("file:")
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        kept = sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(folder) for f in fs)
        return kept + sum(files.apply(k).length() for k in range(files.size()) if files.apply(k).getName().startswith("shuffle"))

    random.seed(6)
    texts = [" ".join(f"w{random.randrange(9000)}" for _ in range(400)) for _ in range(1500)]
    df = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "key string, text string")
    before = used()
    members, links = near_duplicates(df, "key", "text", 3, 0.6)
    assert used() - before < 0.5 * sum(map(len, texts))
    assert members.count() == 1500 and links.count() == 0


def test_reach_loses_nothing():
    """However the order of runs, similar sets share so many runs before both ends."""
    from braidlake.llm.neardup import reach

    random.seed(12)
    tried = 0
    for _ in range(400):
        a = set(random.sample(range(300), random.randrange(1, 90)))
        b = (set(a) - set(random.sample(sorted(a), random.randrange(0, len(a) // 3 + 1)))) | set(random.sample(range(300), random.randrange(0, 20)))
        if not b or len(a & b) < 0.6 * len(a | b):
            continue
        tried += 1
        end_a, end_b, shared = reach(np.array([len(a)]), np.array([len(b)]), 0.6)
        assert len(set(sorted(a)[: end_a[0]]) & set(sorted(b)[: end_b[0]])) >= shared[0] >= 1
    assert tried > 100
