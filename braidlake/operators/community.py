"""Communities of a weighted graph: greedy modularity within components, and a hierarchy by Leiden.

A part of the graph of up to `LARGEST` edges is solved in one task. A larger one is never gathered: its nodes first move
between communities by the same gain of modularity over the edge table, and each community becomes one node, until what
is left fits; the same algorithm then finishes it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braidlake.operators.entities import induced, weighted_degree
from braidlake.operators.graph import connected_components
from braidlake.runtime import checkpointed, may_hold, numbered, ranked

#: Edges that one task may hold.
LARGEST = 200_000


def modularity(links: list[tuple[str, str, float]], label: dict[str, str], resolution: float = 1.0) -> float:
    """Weighted modularity of a partition."""
    total = sum(w for _, _, w in links)
    if not total:
        return 0.0
    inside, degree = 0.0, {}
    for a, b, w in links:
        inside += w * (label[a] == label[b])
        degree[label[a]] = degree.get(label[a], 0.0) + w
        degree[label[b]] = degree.get(label[b], 0.0) + w
    return inside / total - resolution * sum((d / (2 * total)) ** 2 for d in degree.values())


def greedy_modularity(links: list[tuple[str, str, float]]) -> dict[str, str]:
    """Agglomeration (Clauset, Newman and Moore 2004): merge the pair of largest gain until none gains.

    Ties go to the pair of lowest names; a community is named by its lowest member.
    """
    import heapq

    import numpy as np

    total = sum(w for _, _, w in links)
    names = sorted({x for a, b, _ in links for x in (a, b)})
    if not total:
        return {x: x for x in names}
    place = {x: i for i, x in enumerate(names)}
    part = [0.0] * len(names)
    near: list[dict[int, float]] = [{} for _ in names]
    for a, b, w in ((place[a], place[b], w) for a, b, w in links):
        part[a] += w / (2 * total)
        part[b] += w / (2 * total)
        if a != b:
            near[a][b] = near[a].get(b, 0.0) + w / total
            near[b][a] = near[b].get(a, 0.0) + w / total
    share, members = np.array(part), {i: [i] for i in range(len(names))}
    # A pair belongs to the end that changed last, which keeps the gains of its pairs as of then and has only its best one
    # in the heap; a pair whose other end has changed since belongs to that one.
    changed = np.zeros(len(names))
    rows: dict[int, tuple] = {}
    heap: list[tuple] = []

    def push(own: int) -> None:
        others, gains = rows[own]
        if not len(others):
            return
        most = gains.max()
        x = int(others[gains == most].min())
        heapq.heappush(heap, (-float(most), min(own, x), max(own, x), own, changed[own]))

    def weigh(own: int, others, weights) -> None:
        gains = weights - 2 * share[own] * share[others]
        some = gains > 1e-12
        rows[own] = (others[some], gains[some])
        push(own)

    for a in range(len(names)):
        later = [x for x in near[a] if x > a]
        weigh(a, np.array(later, dtype=np.int64), np.array([near[a][x] for x in later]))
    merges = 0
    while heap:
        _, a, b, own, since = heapq.heappop(heap)
        if own not in members or changed[own] != since:
            continue
        if changed[b if own == a else a] > since:
            others, gains = rows[own]
            same = changed[others] <= since
            rows[own] = (others[same], gains[same])
            push(own)
            continue
        keep, drop = (a, b) if len(near[a]) >= len(near[b]) else (b, a)
        members[keep] += members.pop(drop)
        share[keep] += share[drop]
        for x, w in near[drop].items():
            del near[x][drop]
            if x != keep:
                near[keep][x] = near[keep].get(x, 0.0) + w
                near[x][keep] = near[keep][x]
        near[drop] = {}
        rows.pop(drop)
        merges += 1
        changed[keep], changed[drop] = merges, np.inf
        n = len(near[keep])
        weigh(keep, np.fromiter(near[keep].keys(), np.int64, n), np.fromiter(near[keep].values(), float, n))
    return {names[x]: names[min(own)] for own in members.values() for x in own}


def louvain(links: list[tuple[str, str, float]], resolution: float = 1.0) -> dict[str, str]:
    """Local moves and aggregation in a fixed order until modularity stops rising; a community is named by its lowest member."""
    names = sorted({x for a, b, _ in links for x in (a, b)})
    of = {x: x for x in names}
    level = [(a, b, w) for a, b, w in links]
    while True:
        near: dict[str, dict[str, float]] = {}
        degree: dict[str, float] = {}
        for a, b, w in level:
            near.setdefault(a, {})
            near.setdefault(b, {})
            degree[a] = degree.get(a, 0.0) + w
            degree[b] = degree.get(b, 0.0) + w
            if a != b:
                near[a][b] = near[a].get(b, 0.0) + w
                near[b][a] = near[b].get(a, 0.0) + w
        twice = sum(degree.values())
        if not twice:
            return of
        label, volume, moved = {x: x for x in near}, dict(degree), False
        for _ in range(50):
            changed = False
            for x in sorted(near):
                own = label[x]
                volume[own] -= degree[x]
                weights: dict[str, float] = {own: 0.0}
                for y, w in near[x].items():
                    weights[label[y]] = weights.get(label[y], 0.0) + w
                best = min(weights, key=lambda c: (-(weights[c] - resolution * degree[x] * volume[c] / twice), c != own, c))
                if weights[best] - resolution * degree[x] * volume[best] / twice <= weights[own] - resolution * degree[x] * volume[own] / twice + 1e-12:
                    best = own
                label[x] = best
                volume[best] += degree[x]
                changed |= best != own
            moved |= changed
            if not changed:
                break
        if not moved:
            break
        of = {x: label[c] for x, c in of.items()}
        merged: dict[tuple[str, str], float] = {}
        for a, b, w in level:
            k = (min(label[a], label[b]), max(label[a], label[b]))
            merged[k] = merged.get(k, 0.0) + w
        level = [(a, b, w) for (a, b), w in merged.items()]
    lowest: dict[str, str] = {}
    for x in names:
        lowest.setdefault(of[x], x)
    return {x: lowest[of[x]] for x in names}


def leiden(links: list[tuple[str, str, float]], resolution: float = 1.0) -> dict[str, str]:
    """Leiden (Traag, Waltman and van Eck 2019) in a fixed order: local moves, refinement of each community from single
    nodes, aggregation by the refined parts. Communities are connected; each is named by its lowest member."""
    names = sorted({x for a, b, _ in links for x in (a, b)})
    of, start, level = {x: x for x in names}, {x: x for x in names}, list(links)
    while True:
        near: dict[str, dict[str, float]] = {x: {} for x in start}
        degree = dict.fromkeys(start, 0.0)
        for a, b, w in level:
            degree[a] += w
            degree[b] += w
            if a != b:
                near[a][b] = near[a].get(b, 0.0) + w
                near[b][a] = near[b].get(a, 0.0) + w
        twice = sum(degree.values())
        if not twice:
            return of

        def best(x: str, label: dict[str, str], volume: dict[str, float], own: str, allowed=None) -> tuple[float, str]:
            weights = {own: 0.0}
            for y, w in near[x].items():
                if allowed is None or allowed[y] == allowed[x]:
                    weights[label[y]] = weights.get(label[y], 0.0) + w
            gains = {c: w - resolution * degree[x] * volume.get(c, 0.0) / twice for c, w in weights.items()}
            top = min(gains, key=lambda c: (-gains[c], c != own, c))
            return (gains[top], top) if gains[top] > gains[own] + 1e-12 else (gains[own], own)

        label, volume = dict(start), {}
        for x, c in label.items():
            volume[c] = volume.get(c, 0.0) + degree[x]
        for _ in range(50):
            changed = False
            for x in sorted(near):
                own = label[x]
                volume[own] -= degree[x]
                _, label[x] = best(x, label, volume, own)
                volume[label[x]] = volume.get(label[x], 0.0) + degree[x]
                changed |= label[x] != own
            if not changed:
                break
        part, size, inner = {x: x for x in near}, dict.fromkeys(near, 1), dict(degree)
        for x in sorted(near):
            if part[x] != x or size[x] > 1:
                continue
            inner[x] -= degree[x]
            _, to = best(x, part, inner, x, label)
            inner[to] = inner.get(to, 0.0) + degree[x]
            if to != x:
                part[x], size[x] = to, 0
                size[to] += 1
        lowest: dict[str, str] = {}
        if len(set(part.values())) == len(near):  # nothing merges any more
            for x in names:
                lowest.setdefault(label[of[x]], x)
            return {x: lowest[label[of[x]]] for x in names}
        for x in sorted(near):
            lowest.setdefault(label[x], part[x])
        start = {part[x]: lowest[label[x]] for x in near}
        of = {x: part[c] for x, c in of.items()}
        merged: dict[tuple[str, str], float] = {}
        for a, b, w in level:
            k = (min(part[a], part[b]), max(part[a], part[b]))
            merged[k] = merged.get(k, 0.0) + w
        level = [(a, b, w) for (a, b), w in merged.items()]


def _by_group(links: DataFrame, algorithm) -> DataFrame:
    """(group, node, label) by a function of a group's edge list; `links` has (group, src, dst, weight)."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        rows = sorted((a, b, float(w)) for a, b, w in zip(part["src"], part["dst"], part["weight"]))
        found = algorithm(rows)
        return pd.DataFrame({"group": part["group"].iloc[0], "node": list(found), "label": list(found.values())})

    return links.select("group", "src", "dst", "weight").groupBy("group").applyInPandas(run, "group string, node string, label string")


def moved(links: DataFrame, resolution: float = 1.0, rounds: int = 30, still: float = 0.001) -> DataFrame:
    """(group, node, label): nodes after local moves over the edge table.

    In a round every node weighs the communities around it by the gain of modularity, as Louvain's local moves do; even
    and odd nodes (by hash and round) move in turn, so that two ends don't swap for ever. A round is a few joins and
    aggregations; rounds end when fewer than `still` of all nodes moved in two of them, or after `rounds`, since a later
    level goes on with what is left.
    """
    both = checkpointed(links.select("group", F.col("src").alias("node"), F.col("dst").alias("other"), "weight").union(links.select("group", "dst", "src", "weight")))
    degrees = checkpointed(both.groupBy("group", "node").agg(F.sum("weight").alias("degree")))
    twice = degrees.groupBy("group").agg(F.sum("degree").alias("_twice"))
    around = both.where("node <> other")
    labels = degrees.withColumn("label", F.col("node"))
    total, calm = degrees.count(), 0
    for r in range(rounds):
        volume = labels.groupBy("group", "label").agg(F.sum("degree").alias("_volume"))
        seen = around.join(labels.select("group", F.col("node").alias("other"), "label"), ["group", "other"]).groupBy("group", "node", "label").agg(F.sum("weight").alias("_w"))
        own = labels.select("group", "node", F.col("label").alias("_own"), "degree")
        options = seen.unionByName(labels.select("group", "node", "label", F.lit(0.0).alias("_w"))).groupBy("group", "node", "label").agg(F.sum("_w").alias("_w"))
        weighed = options.join(own, ["group", "node"]).join(volume, ["group", "label"]).join(twice, "group")
        here = F.col("label") == F.col("_own")
        rest = F.col("_volume") - F.when(here, F.col("degree")).otherwise(0.0)
        gain = F.col("_w") - F.lit(resolution) * F.col("degree") * rest / F.col("_twice")
        best = weighed.withColumn("_gain", gain).groupBy("group", "node").agg(
            F.max("_gain").alias("_most"), F.max(F.when(here, F.col("_gain"))).alias("_stay"), F.max_by("label", F.struct("_gain", F.bitwise_not(F.xxhash64("label")))).alias("_best")
        )
        turn = F.pmod(F.xxhash64("node", F.lit(r // 2)), F.lit(2)) == r % 2
        goes = turn & (F.col("_most") > F.col("_stay") + 1e-12)
        now = checkpointed(labels.join(best, ["group", "node"]).select("group", "node", "degree", F.when(goes, F.col("_best")).otherwise(F.col("label")).alias("label"), goes.cast("int").alias("_moves")))
        moves = now.agg(F.coalesce(F.sum("_moves"), F.lit(0)).alias("n")).first()["n"]
        labels = now.drop("_moves")
        calm = calm + 1 if moves <= still * total else 0
        if calm == 2:
            break
    return labels.select("group", "node", "label")


def divided(grouped: DataFrame, algorithm, largest: int = LARGEST, resolution: float = 1.0) -> DataFrame:
    """(group, node, label) of each group of edges (group, src, dst, weight), whatever its size."""
    sizes = checkpointed(grouped.groupBy("group").agg(F.count("*").alias("_n")))
    large = sizes.where(F.col("_n") > largest).select("group")
    if large.isEmpty():
        return _by_group(grouped, algorithm)
    found = _by_group(grouped.join(large, "group", "left_anti"), algorithm)
    whole = checkpointed(grouped.join(large, "group", "left_semi"))
    step = checkpointed(moved(whole, resolution))
    to = lambda x: step.select("group", F.col("node").alias(x), F.col("label").alias(f"_{x}"))
    ends = whole.join(to("src"), ["group", "src"]).join(to("dst"), ["group", "dst"])
    coarse = checkpointed(ends.groupBy("group", F.least("_src", "_dst").alias("src"), F.greatest("_src", "_dst").alias("dst")).agg(F.sum("weight").alias("weight")))
    if coarse.count() >= whole.count():  # nothing moves together: the communities are what they are
        last = step
    else:
        inner = divided(coarse, algorithm, largest, resolution)
        last = step.join(inner.select("group", F.col("node").alias("label"), F.col("label").alias("_to")), ["group", "label"]).select("group", "node", F.col("_to").alias("label"))
    lowest = last.groupBy("group", "label").agg(F.min("node").alias("_first"))
    return found.unionByName(last.join(lowest, ["group", "label"]).select("group", "node", F.col("_first").alias("label")))


def partition(links: DataFrame, nodes: DataFrame, algorithm=greedy_modularity, largest: int = LARGEST, resolution: float = 1.0) -> DataFrame:
    """(node, label): the community of every node; a node without edges is its own.

    `largest` is the number of edges up to which a component is solved in one task.
    """
    clean = links.where("src <> dst").select("src", "dst", F.col("weight").cast("double").alias("weight"))
    component = connected_components(clean).select("node", F.col("component").alias("group"))
    grouped = checkpointed(clean.join(component.withColumnRenamed("node", "src"), "src").select("group", "src", "dst", "weight"))
    found = divided(grouped, algorithm, largest, resolution)
    return nodes.select("node").distinct().join(found.select("node", "label"), "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def communities(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(community_id, node, member_rank, size): communities by size, then first member, numbered from 0.

    `nodes` has (node, mention_count); members go by mentions, then lower-case name.
    """
    return named_communities(partition(links, nodes).join(nodes.select("node", "mention_count"), "node"))


def named_communities(parts: DataFrame) -> DataFrame:
    """The table of `communities` of a division (node, label, mention_count). Numbers and ranks are taken over range
    partitions, so neither all communities nor a large one are sorted in one task."""
    parts = checkpointed(parts)
    order = F.struct((-F.col("mention_count")).alias("m"), F.lower("node").alias("n"), F.col("node").alias("x"))
    heads = parts.groupBy("label").agg(F.count("*").alias("size"), F.min(order)["x"].alias("first"))
    heads = heads.withColumn("_size", -F.col("size")).withColumn("_name", F.lower("first"))
    ids = numbered(heads, ["_size", "_name", "first"], "community_id").select("label", "size", "community_id")
    placed = parts.join(ids, "label").withColumn("_mentions", -F.col("mention_count")).withColumn("_name", F.lower("node"))
    return ranked(placed, ["community_id"], ["_mentions", "_name", "node"], "member_rank").select("community_id", "node", "member_rank", "size")


def hierarchy(links: DataFrame, nodes: DataFrame, levels: int = 3, min_size: int = 5, resolution: float = 1.0, method=leiden, largest: int = LARGEST) -> DataFrame:
    """(id, level, parent_id, node): level 0 divides all nodes; a community of at least max(2 min_size, 4) members is
    divided again on its own edges; a division into one part is dropped. `method` is `leiden` or `louvain`."""
    algorithm = lambda rows: method(rows, resolution)
    top = partition(links, nodes, algorithm, largest, resolution).select("node", F.col("label").alias("part"), F.lit(None).cast("string").alias("parent_id"))
    out, current = None, top
    for level in range(levels):
        ids = current.groupBy("parent_id", "part").agg(F.count("*").alias("size"))
        ids = numbered(ids.withColumn("_size", -F.col("size")), ["parent_id", "_size", "part"], "_number")
        ids = ids.withColumn("id", F.format_string(f"L{level}-C%05d", "_number"))
        ids = ids.select("id", "size", F.col("part").alias("_part"), F.col("parent_id").alias("_parent"))
        same = F.col("part").eqNullSafe(F.col("_part")) & F.col("parent_id").eqNullSafe(F.col("_parent"))
        named = checkpointed(current.join(ids, same).select("id", F.lit(level).alias("level"), "parent_id", "node", "size"))
        rows = named.drop("size")
        out = rows if out is None else out.unionByName(rows)
        if level + 1 == levels:
            break
        large = named.where(F.col("size") >= max(2 * min_size, 4)).select("node", F.col("id").alias("group"))
        if large.isEmpty():
            break
        inner = checkpointed(induced(links.where("src <> dst").select("src", "dst", F.col("weight").cast("double").alias("weight")), large))
        found = divided(inner.select("group", "src", "dst", "weight"), algorithm, largest, resolution)
        parts = large.join(found.select("node", "label"), "node", "left").select("node", F.coalesce("label", "node").alias("part"), F.col("group").alias("parent_id"))
        split = parts.groupBy("parent_id").agg(F.count_distinct("part").alias("_n")).where("_n > 1").select("parent_id")
        current = checkpointed(parts.join(split, "parent_id", "left_semi").select("node", "part", "parent_id"))
        if current.isEmpty():
            break
    return out


def _texts(candidates: DataFrame, chunks: DataFrame | None) -> tuple[DataFrame, list[str]]:
    """The texts of candidates, one row per key, and the columns of the key: `chunks` if given, whatever the community,
    else what the candidates hold."""
    on = ["community_id", "source", "chunk_id"] if chunks is None else ["source", "chunk_id"]
    rows = candidates.dropDuplicates(on) if chunks is None else chunks
    return rows.select(*on, "text").where("text is not null"), on


def entity_matches(members: DataFrame, candidates: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """(community_id, node, coverage, hits): chunks of the community that name a node, and how often they do in all.

    `members` has (community_id, node), `candidates` (community_id, source, chunk_id) and text, unless `chunks` (source,
    chunk_id, text; one row per key) has it. Names stand as whole words, whatever the case. A name meets only the chunks
    that hold its first two words side by side, by narrow rows that are made only for words that some name begins with;
    texts are moved once, whatever the number of communities.
    """
    from braidlake.functions import text as T

    words = lambda x: F.regexp_extract_all(F.lower(F.upper(x)), F.lit(r"([\p{L}\p{N}_]+)"), 1)
    hashed = lambda a, b: F.xxhash64(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))
    names = members.select("community_id", "node", T.collapse(F.regexp_replace("node", "^[^:]*::", "")).alias("_name")).where("_name <> ''")
    # A name of one word meets that word, a name without a word every chunk by the empty one.
    names = checkpointed(names.withColumn("_key", hashed(F.get(words("_name"), F.lit(0)), F.get(words("_name"), F.lit(1)))))
    known = may_hold(names, "_key")
    texts, on = _texts(candidates, chunks)
    texts = texts.withColumn("text", T.collapse("text"))
    said = texts.select(*on, words("text").alias("_w"))
    pairs = F.zip_with("_w", F.slice("_w", 2, F.greatest(F.size("_w"), F.lit(1))), hashed)
    keys = F.concat(F.transform("_w", lambda x: hashed(x, F.lit(""))), pairs, F.array(hashed(F.lit(""), F.lit(""))))
    held = said.select(*on, F.explode(F.array_distinct(F.filter(keys, known))).alias("_key"))
    # A chunk's communities are gathered; there are no more of them than names in its text.
    homes = candidates.groupBy("source", "chunk_id").agg(F.collect_set("community_id").alias("_homes"))
    met = held.join(names, [*on[:-2], "_key"]).drop("_key")
    own = met.join(homes, ["source", "chunk_id"]).where(F.array_contains("_homes", F.col("community_id"))).drop("_homes")
    counted = own.join(texts, on).withColumn("_hits", T.mention_count("text", "_name")).where("_hits > 0")
    return counted.groupBy("community_id", "node").agg(F.count("*").alias("coverage"), F.sum("_hits").alias("hits"))


def rank_entities(members: DataFrame, links: DataFrame, matches: DataFrame) -> DataFrame:
    """Members by log1p(mentions) + 1.5 log1p(degree inside) + 2 chunks matched + 0.5 log1p(matches).

    `members` has (community_id, node, mention_count), `matches` (community_id, node, coverage, hits), or no row for
    a node that no chunk text names.
    """
    group = members.select("node", F.col("community_id").alias("group"))
    inner = induced(links, group)
    degree = inner.select("group", F.col("src").alias("node"), "weight").union(inner.select("group", "dst", "weight")).groupBy("node").agg(F.sum("weight").alias("degree"))
    scored = members.join(degree, "node", "left").join(matches.select("community_id", "node", "coverage", "hits"), ["community_id", "node"], "left").na.fill(0, ["degree", "coverage", "hits"])
    score = F.log1p("mention_count") + 1.5 * F.log1p("degree") + 2.0 * F.col("coverage") + 0.5 * F.log1p("hits")
    placed = scored.withColumn("score", F.round(score, 6)).withColumn("_score", -F.col("score")).withColumn("_name", F.lower("node"))
    return ranked(placed, ["community_id"], ["_score", "_name", "node"], "rank").drop("_score", "_name")


def cover_score(text: str, names: list[str]) -> tuple[set[str], float]:
    """The names a text holds and its base score.

    The base is the sum over names of min(count, 4) x max(1, 4 - 0.2 rank), 2 per name, and min(length, 1500) / 1500.
    """
    low = text.lower()
    counts = {n: low.count(n.lower()) for n in names if n}
    held = {n for n, c in counts.items() if c}
    return held, sum(min(counts[n], 4) * max(1.0, 4 - 0.2 * r) for r, n in enumerate(names) if n in held) + 2 * len(held) + min(len(low), 1500) / 1500


def greedy_cover(texts: list[str], names: list[str], most: int) -> list[int]:
    """Positions of up to `most` texts: base score + 3 per name not covered yet - 0.25 per covered one, first wins ties."""
    scores = [cover_score(t, names) for t in texts]
    own, base = [h for h, _ in scores], [b for _, b in scores]
    chosen: list[int] = []
    covered: set[str] = set()
    while len(chosen) < min(most, len(texts)):
        best = max((i for i in range(len(texts)) if i not in chosen), key=lambda i: (base[i] + 3 * len(own[i] - covered) - 0.25 * len(own[i] & covered), -i))
        chosen.append(best)
        covered |= own[best]
    return chosen


def scored_chunks(candidates: DataFrame, leading: DataFrame, most_entities: int = 20, chunks: DataFrame | None = None) -> DataFrame:
    """(community_id, source, chunk_id, base, held): the base score of each chunk (see `cover_score`) and the places of the
    leading names it holds. Copies by signature drop out first, the one of the lowest key stays. `chunks` is that of
    `entity_matches`."""
    from braidlake.functions import text as T

    names = leading.where(F.col("rank") <= most_entities).groupBy("community_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "node"))), lambda x: F.substring_index(x["node"], "::", -1)).alias("names"))
    texts, on = _texts(candidates, chunks)
    texts = texts.withColumn("text", T.collapse("text"))
    signed = texts.where(T.signature("text") != "").select(*on, F.md5(F.encode(T.signature("text"), "utf-8")).alias("_sig"))
    keys = candidates.select("community_id", "source", "chunk_id").distinct().join(signed, on)
    once = keys.groupBy("community_id", "_sig").agg(F.min_by(F.struct("source", "chunk_id"), T.chunk_key("source", "chunk_id")).alias("c")).select("community_id", "c.*")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[["community_id", "source", "chunk_id"]].copy()
            scores = [cover_score(t, list(n)) for t, n in zip(batch["text"], batch["names"])]
            out["base"] = [b for _, b in scores]
            out["held"] = [sorted(list(n).index(x) for x in h) for (h, _), n in zip(scores, batch["names"])]
            yield out

    kinds = {c: once.schema[c].dataType.simpleString() for c in ("source", "chunk_id")}
    rows = once.join(names, "community_id").join(texts, on).select("community_id", "source", "chunk_id", "text", "names")
    return rows.mapInPandas(score, f"community_id bigint, source {kinds['source']}, chunk_id {kinds['chunk_id']}, base double, held array<int>")


def representative_chunks(candidates: DataFrame, leading: DataFrame, most_entities: int = 20, most_chunks: int = 8, chunks: DataFrame | None = None, largest: int = LARGEST) -> DataFrame:
    """(community_id, position, source, chunk_id): chunks that cover a community's leading entities.

    `candidates` has (community_id, source, chunk_id, text), `leading` (community_id, node, rank); `chunks` is that of
    `entity_matches`. Copies by signature drop out first. The choice is that of `greedy_cover` over all chunks of a
    community: a chunk becomes a narrow row of its base score and the names it holds. Chunks that hold the same names
    gain alike by any choice, so only those of the best bases, and of equal bases the first keys, can be chosen; a
    community that has up to `largest` of them left is decided in one task, a larger one by rounds of an aggregation.
    """
    from braidlake.functions import text as T

    scored = scored_chunks(candidates, leading, most_entities, chunks).withColumn("key", T.chunk_key("source", "chunk_id"))
    first = Window.partitionBy("community_id", "held", "base").orderBy("key")
    # Rounded, since sums that differ in the last bits may become equal by what is added.
    best_bases = Window.partitionBy("community_id", "held").orderBy(F.desc(F.round("base", 6)))
    few = scored.withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= most_chunks)
    rows = checkpointed(few.withColumn("_k", F.dense_rank().over(best_bases)).where(F.col("_k") <= most_chunks).drop("_k"))
    large = checkpointed(rows.groupBy("community_id").agg(F.count("*").alias("_n")).where(F.col("_n") > largest).select("community_id"))
    if large.isEmpty():
        return _chosen(rows, most_chunks)
    some = _chosen(rows.join(large, "community_id", "left_anti"), most_chunks)
    return some.unionByName(_chosen_in_rounds(rows.join(large, "community_id", "left_semi"), most_chunks))


def _chosen(rows: DataFrame, most: int) -> DataFrame:
    """(community_id, position, source, chunk_id): the greedy choice among rows (…, key, base, held), a community a task."""
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("source", "chunk_id")}

    def choose(part: pd.DataFrame) -> pd.DataFrame:
        own = [frozenset(h) for h in part["held"]]
        left = list(zip(part["key"], part["base"], own, range(len(part))))
        covered, picked = frozenset(), []
        while left and len(picked) < most:
            best = min(left, key=lambda x: (-(x[1] + 3.0 * len(x[2] - covered) - 0.25 * len(x[2] & covered)), x[0]))
            left.remove(best)
            picked.append(best[3])
            covered |= best[2]
        out = part.iloc[picked][["community_id", "source", "chunk_id"]]
        return out.assign(position=range(len(out)))[["community_id", "position", "source", "chunk_id"]]

    return rows.groupBy("community_id").applyInPandas(choose, f"community_id bigint, position int, source {kinds['source']}, chunk_id {kinds['chunk_id']}")


def _chosen_in_rounds(rows: DataFrame, most: int) -> DataFrame:
    """`_chosen` by one aggregation per chosen chunk, so that no community is gathered."""
    state = rows.select("community_id").distinct().withColumn("covered", F.array().cast("array<int>")).withColumn("picked", F.array().cast("array<string>"))
    for _ in range(most):
        gain = F.col("base") + 3.0 * F.size(F.array_except("held", "covered")) - 0.25 * F.size(F.array_intersect("held", "covered"))
        left = rows.join(state, "community_id").where(~F.array_contains("picked", F.col("key"))).withColumn("_gain", gain)
        best = left.groupBy("community_id").agg(F.min_by(F.struct("key", "held"), F.struct(-F.col("_gain"), "key")).alias("_best"))
        added = F.when(F.col("_best").isNotNull(), F.array("_best.key")).otherwise(F.array().cast("array<string>"))
        state = checkpointed(
            state.join(best, "community_id", "left").select("community_id", F.array_union("covered", F.coalesce("_best.held", F.array().cast("array<int>"))).alias("covered"), F.concat("picked", added).alias("picked"))
        )
    places = state.select("community_id", F.posexplode("picked").alias("position", "key"))
    return places.join(rows, ["community_id", "key"]).select("community_id", "position", "source", "chunk_id")


def summaries(members: DataFrame, leading: DataFrame, chosen: DataFrame, chunks: DataFrame, model=None, previous: DataFrame | None = None, force: bool = False) -> DataFrame:
    """(community_id, title, summary, summary_status): generated from the chosen chunks of communities with two members
    or more; `insufficient_evidence` without chunks, `fallback` where the model gives nothing, `failed` where it raises.

    `previous` has the same columns: a community that it has a generated summary for keeps it, unless `force`.
    """
    from braidlake.functions.models import TemplateGenerator, retrying

    generator = model or TemplateGenerator()
    title = leading.where("rank <= 2").groupBy("community_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "node"))), lambda x: x["node"]), " and ").alias("title"))
    sizes = members.groupBy("community_id").agg(F.count("*").alias("_n")).where("_n >= 2")
    kept = None
    if previous is not None and not force:
        kept = checkpointed(previous.where("summary_status = 'generated'").join(sizes, "community_id", "left_semi").select("community_id", "title", "summary", "summary_status"))
        sizes = sizes.join(kept.select("community_id"), "community_id", "left_anti")
    evidence = chosen.join(chunks, ["source", "chunk_id"]).groupBy("community_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x["text"]), "\n\n").alias("evidence"))
    rows = sizes.join(title, "community_id", "left").join(evidence, "community_id", "left")

    @F.pandas_udf("text string, failed boolean")
    def write(prompts: pd.Series) -> pd.DataFrame:
        try:
            out = retrying(lambda: generator.generate(["Summarise what links these.\nEVIDENCE: " + (p or "") for p in prompts]))
            return pd.DataFrame({"text": pd.Series(out, dtype=object), "failed": False})
        except Exception:  # the other communities must not wait for a model that refuses these
            return pd.DataFrame({"text": pd.Series([None] * len(prompts), dtype=object), "failed": True})

    written = checkpointed(rows.withColumn("_s", F.when(F.col("evidence").isNotNull(), write("evidence"))))
    status = (
        F.when(F.col("evidence").isNull(), "insufficient_evidence").when(F.col("_s.failed"), "failed").when(F.trim(F.coalesce("_s.text", F.lit(""))) == "", "fallback").otherwise("generated")
    )
    fallback = F.concat(F.lit("Community of "), F.coalesce("title", F.lit("unnamed entities")))
    new = written.select("community_id", F.coalesce("title", F.concat(F.lit("Community "), F.col("community_id").cast("string"))).alias("title"), F.when(status == "generated", F.col("_s.text")).otherwise(fallback).alias("summary"), status.alias("summary_status"))
    return new if kept is None else new.unionByName(kept)


def community_list(members: DataFrame, held: DataFrame, summaries: DataFrame | None = None, top: int = 7, blank: str = "No summary yet.") -> DataFrame:
    """(community_id, size, top_entities, num_chunks, summary): one row per community.

    `members` has (community_id, node, member_rank), `held` (node, source, chunk_id), `summaries` (community_id, summary).
    """
    heads = members.groupBy("community_id").agg(F.count("*").alias("size"))
    firsts = members.where(F.col("member_rank") <= top).groupBy("community_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("member_rank", "node"))), lambda x: x["node"]).alias("top_entities"))
    counts = members.join(held, "node").select("community_id", "source", "chunk_id").distinct().groupBy("community_id").agg(F.count("*").alias("num_chunks"))
    rows = heads.join(firsts, "community_id").join(counts, "community_id", "left")
    rows = rows.join(summaries.select("community_id", "summary"), "community_id", "left") if summaries is not None else rows.withColumn("summary", F.lit(None).cast("string"))
    return rows.select("community_id", "size", "top_entities", F.coalesce("num_chunks", F.lit(0)).alias("num_chunks"), F.coalesce(F.nullif(F.trim("summary"), F.lit("")), F.lit(blank)).alias("summary"))


def community_view(listed: DataFrame, top: int = 5) -> DataFrame:
    """What a graph view shows of `community_list`: no communities of one entity, the first `top` of each."""
    return listed.where("size <> 1").withColumn("top_entities", F.slice("top_entities", 1, top))


def report_contexts(
    groups: DataFrame, links: DataFrame, entities: DataFrame, relations: DataFrame, entity_chunks: DataFrame, relation_chunks: DataFrame, chunks: DataFrame, most: tuple[int, int, int] = (25, 35, 12)
) -> DataFrame:
    """(community_id, context, chunk_ids): what a report on a community is written from.

    The context names the `most` entities of largest weighted degree, the heaviest relations between them, and excerpts
    of the first chunks of both, in their order. Tables: groups (community_id, node), links (src, dst, weight), entities
    (id, name, type, description), relations (source, target, type, weight, description), entity_chunks (id, pos, chunk_id),
    relation_chunks (source, target, type, pos, chunk_id), chunks (chunk_id, source, page, text). Every cut is a window whose
    rows are limited before the shuffle.
    """
    from braidlake.functions import text as T

    first = lambda by: F.row_number().over(Window.partitionBy("community_id").orderBy(*by))
    lines = lambda df, into, sep: df.groupBy("community_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "_line"))), lambda x: x["_line"]), sep).alias(into))
    degrees = weighted_degree(links).select("node", "degree")
    chosen = groups.select("community_id", "node").distinct().join(degrees, "node", "left").na.fill(0, ["degree"])
    chosen = chosen.withColumn("_r", first([F.desc("degree"), F.asc("node")])).where(F.col("_r") <= most[0]).select("community_id", F.col("node").alias("id"), "_r")
    named = checkpointed(chosen.join(entities.select("id", "name", "type", "description"), "id"))
    told = named.select("community_id", "_r", T.entity_line("name", "type", "description").alias("_line"))
    end = lambda x: named.select(F.col("community_id").alias(f"_c{x}"), F.col("id").alias(x), F.col("name").alias(f"_{x}"))
    between = relations.join(end("source"), "source").join(end("target"), "target").where("_csource = _ctarget").withColumn("community_id", F.col("_csource"))
    between = checkpointed(between.withColumn("_r", first([F.desc("weight"), F.asc("source"), F.asc("target"), F.asc("type")])).where(F.col("_r") <= most[1]))
    related = between.select("community_id", "_r", T.relation_line("_source", "type", "_target", "description").alias("_line"))
    of_entities = named.join(entity_chunks, "id").select("community_id", "chunk_id", F.struct(F.lit(0).alias("part"), "_r", "pos").alias("_at"))
    of_relations = between.select("community_id", "_r", "source", "target", "type").join(relation_chunks, ["source", "target", "type"]).select("community_id", "chunk_id", F.struct(F.lit(1).alias("part"), "_r", "pos").alias("_at"))
    once = of_entities.unionByName(of_relations).groupBy("community_id", "chunk_id").agg(F.min("_at").alias("_at"))
    cited = checkpointed(once.withColumn("_r", first(["_at", "chunk_id"])).where(F.col("_r") <= most[2]))
    texts = cited.join(chunks.select("chunk_id", "source", "page", "text"), "chunk_id")
    excerpts = texts.select("community_id", "_r", F.concat(T.citation("chunk_id", "source", "page"), F.lit("\n"), F.substring("text", 1, 900)).alias("_line"))
    ids = cited.groupBy("community_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "chunk_id"))), lambda x: x["chunk_id"]).alias("chunk_ids"))
    rows = groups.select("community_id").distinct()
    for part in (lines(told, "_e", "\n"), lines(related, "_l", "\n"), lines(excerpts, "_x", "\n\n"), ids):
        rows = rows.join(part, "community_id", "left")
    plain = lambda c: F.coalesce(c, F.lit(""))
    context = F.concat(F.lit("ENTITIES\n"), plain("_e"), F.lit("\n\nRELATIONSHIPS\n"), plain("_l"), F.lit("\n\nSOURCE EXCERPTS\n"), plain("_x"))
    return rows.select("community_id", context.alias("context"), F.coalesce("chunk_ids", F.array().cast("array<string>")).alias("chunk_ids"))


class ReportWriter:
    """The default writer of community reports, a generator of JSON: titled by the first entity, a finding per excerpt."""

    def generate(self, prompts) -> list[str]:
        import json
        import re

        out = []
        for p in prompts:
            entities, _, rest = p.split("ENTITIES\n", 1)[1].partition("\n\nRELATIONSHIPS\n")
            excerpts = rest.partition("\n\nSOURCE EXCERPTS\n")[2]
            names = re.findall(r"(?m)^- (.*?) \[", entities)
            findings = [f"{re.split(r'(?<=[.!?])[ ]', t.strip())[0]} [{c}]" for c, t in re.findall(r"(?m)^\[([^\]]+)\][^\n]*\n([^\n]*)", excerpts)][:7]
            out.append(json.dumps({"title": names[0] if names else "", "summary": "Concerns " + ", ".join(names[:5]) + "." if names else "", "findings": findings}))
        return out


def community_reports(contexts: DataFrame, model=None, attempts: int = 3) -> DataFrame:
    """(community_id, title, summary, findings, chunk_ids, text): reports a model writes from `report_contexts`.

    A reply without a title is titled by its community; one that stays invalid gives a report without text.
    """
    from braidlake.functions import text as T
    from braidlake.functions.models import asked
    from braidlake.operators.entities import _is_object

    valid = lambda reply: _is_object(reply, ())
    prompt = F.concat(F.lit("Report on this community as JSON: title, summary, findings.\n"), "context")
    rows = checkpointed(contexts.withColumn("_r", F.from_json(T.json_object(asked(prompt, model or ReportWriter(), valid, attempts=attempts)), "title string, summary string, findings array<string>")))
    title = F.coalesce(F.nullif(T.strip("_r.title"), F.lit("")), F.col("community_id").cast("string"))
    summary, findings = F.coalesce(T.strip("_r.summary"), F.lit("")), T.filled("_r.findings")
    return rows.select("community_id", title.alias("title"), summary.alias("summary"), findings.alias("findings"), "chunk_ids", T.report_text(title, summary, findings).alias("text"))
