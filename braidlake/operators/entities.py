"""Entity mentions, the co-occurrence graph, and its canonical form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidlake.functions import text as T

# Entity labels that are kept.
LABELS = ("PERSON", "NORP", "FAC", "ORG", "GPE", "LOC", "PRODUCT", "EVENT", "WORK_OF_ART", "LAW", "LANGUAGE")
#: Runs of two or more capitalised words: the default extractor's idea of a name.
NAME_RUN = r"\p{Lu}[\p{Ll}]+(?:[- ]\p{Lu}[\p{Ll}]+)+"
# Last words of names and the label they speak for.
LABEL_BY_WORD = {
    "ORG": ("institute", "college", "consortium", "foundation", "society", "press", "archive", "hospital", "company", "office", "group", "museum", "observatory", "laboratory", "survey", "project"),
    "LOC": ("valley", "basin", "ridge", "reef", "marsh", "peak", "canal", "bay", "lake"),
    "FAC": ("station", "road", "bridge", "quarter"),
}


def label_of(name: Column) -> Column:
    """The label of a name by its last word; PERSON where no word speaks for another."""
    last = F.lower(F.element_at(F.split(name, "[- ]"), -1))
    out = F.lit("PERSON")
    for label, words in LABEL_BY_WORD.items():
        out = F.when(last.isin(*words), label).otherwise(out)
    return out


def mentions(chunks: DataFrame, extractor=None) -> DataFrame:
    """(source, chunk_id, sent_id, pos, name, label): every valid mention of a whitelisted label.

    `extractor` maps (source, chunk_id, text) rows to such a table; the default finds runs of capitalised words.
    """
    rows = chunks.select("source", "chunk_id", "text").where("text is not null")
    if extractor is not None:
        found = extractor(rows)
    else:
        sent = rows.select("source", "chunk_id", F.posexplode(T.sentences("text")).alias("sent_id", "_s"))
        found = sent.select("source", "chunk_id", "sent_id", F.posexplode(F.regexp_extract_all("_s", F.lit(NAME_RUN), 0)).alias("pos", "_raw"))
        found = found.withColumn("label", label_of(F.col("_raw"))).withColumn("name", T.normal_entity("_raw")).drop("_raw")
    return found.where(F.col("label").isin(*LABELS) & T.valid_entity("name")).select("source", "chunk_id", "sent_id", "pos", "name", "label")


def node_stats(mentioned: DataFrame) -> DataFrame:
    """(node_id, name, label, mention_count, chunk_count)."""
    rows = mentioned.withColumn("node_id", T.node_id("label", "name"))
    per_chunk = rows.groupBy("node_id", "name", "label", "source", "chunk_id").agg(F.count("*").alias("_n"))
    return per_chunk.groupBy("node_id", "name", "label").agg(F.sum("_n").alias("mention_count"), F.count("*").alias("chunk_count"))


def entity_chunks(mentioned: DataFrame) -> DataFrame:
    return mentioned.select(T.node_id("label", "name").alias("node_id"), "source", "chunk_id").distinct()


def edge_chunks(mentioned: DataFrame) -> DataFrame:
    """(src, dst, source, chunk_id, weight): per chunk, the number of its sentences that hold both, src < dst.

    A sentence's names are gathered within its chunk row, whose text bounds them.
    """
    sent = mentioned.groupBy("source", "chunk_id", "sent_id").agg(F.array_sort(F.collect_set(T.node_id("label", "name"))).alias("_ids")).where(F.size("_ids") > 1)
    one = sent.select("source", "chunk_id", "_ids", F.posexplode("_ids").alias("_at", "src"))
    pairs = one.select("source", "chunk_id", "src", F.explode(F.slice("_ids", F.col("_at") + 2, F.size("_ids"))).alias("dst"))
    return pairs.groupBy("src", "dst", "source", "chunk_id").agg(F.count("*").alias("weight"))


def edges(per_chunk: DataFrame) -> DataFrame:
    """(src, dst, weight, chunk_count)."""
    return per_chunk.groupBy("src", "dst").agg(F.sum("weight").alias("weight"), F.count("*").alias("chunk_count"))


def prune(nodes: DataFrame, links: DataFrame, min_chunks: int = 1, min_weight: int = 1) -> tuple[DataFrame, DataFrame]:
    """Nodes in at least `min_chunks` chunks, and edges of at least `min_weight` between them."""
    kept = nodes.where(F.col("chunk_count") >= min_chunks)
    ids = kept.select("node_id")
    strong = links.where(F.col("weight") >= min_weight)
    strong = strong.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    return kept, strong


def canonical_names(nodes: DataFrame) -> DataFrame:
    """The default canonicaliser: (old_id, name, label, removed). A leading article goes; names without a letter are removed."""
    name = F.regexp_replace("name", "^(?:the|a|an) ", "")
    return nodes.select(F.col("node_id").alias("old_id"), name.alias("name"), "label", (~name.rlike(r"\p{L}")).alias("removed"))


def canonicalize(nodes: DataFrame, held: DataFrame, per_chunk: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and (node_id, source, chunk_id) after a mapping: mentions add up, chunk sets are united under the new
    ids, self loops drop out.

    Nodes that the mapping doesn't name stay as they are; removed wins over mapped.
    """
    moved = (
        nodes.join(mapping.withColumnRenamed("old_id", "node_id").select("node_id", F.col("name").alias("_n"), F.col("label").alias("_l"), "removed"), "node_id", "left")
        .where(~F.coalesce("removed", F.lit(False)))
        .select("node_id", F.coalesce("_n", "name").alias("name"), F.coalesce("_l", "label").alias("label"), "mention_count")
        .withColumn("new_id", T.node_id("label", "name"))
    )
    new_held = held.join(moved.select("node_id", "new_id"), "node_id").select(F.col("new_id").alias("node_id"), "source", "chunk_id").distinct()
    where = new_held.groupBy(F.col("node_id").alias("new_id")).agg(F.count("*").alias("chunk_count"))
    counts = moved.groupBy("new_id", "name", "label").agg(F.sum("mention_count").alias("mention_count"))
    new_nodes = counts.join(where, "new_id").select(F.col("new_id").alias("node_id"), "name", "label", "mention_count", "chunk_count")
    ends = moved.select("node_id", "new_id")
    remapped = (
        per_chunk.join(ends.select(F.col("node_id").alias("src"), F.col("new_id").alias("_a")), "src")
        .join(ends.select(F.col("node_id").alias("dst"), F.col("new_id").alias("_b")), "dst")
        .where("_a <> _b")
        .groupBy(F.least("_a", "_b").alias("src"), F.greatest("_a", "_b").alias("dst"), "source", "chunk_id")
        .agg(F.sum("weight").alias("weight"))
    )
    return new_nodes, edges(remapped), new_held


def merge_entities(extracted: DataFrame) -> DataFrame:
    """Entities of one slug merged: (id, name, type, description, chunk_count), the first name and type win.

    `extracted` has (pos, name, type, description, chunk_id); pos orders the extractions. The description joins the
    first six distinct ones. Chunks stay rows (`merged_chunks`): a frequent entity would make an array of any length.
    """
    rows = _slugged(extracted)
    heads = rows.groupBy("id").agg(F.min_by("name", "pos").alias("name"), F.min_by("type", "pos").alias("type"))
    counts = merged_chunks(extracted).groupBy("id").agg(F.count("*").alias("chunk_count"))
    texts = first_descriptions(rows, ["id"])
    return heads.join(texts, "id", "left").join(counts, "id", "left").select("id", "name", "type", F.coalesce("description", F.lit("")).alias("description"), F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"))


def first_descriptions(rows: DataFrame, keys: list[str], most: int = 6) -> DataFrame:
    """(keys, description): the first `most` distinct descriptions of each key that aren't blank, joined with blanks.

    `rows` has the keys, description and pos, which orders them; equal places go by the text. A window keeps `most` rows
    per task before the shuffle, so a key with any number of descriptions sends few.
    """
    said = rows.where("trim(description) <> ''").groupBy(*keys, "description").agg(F.min("pos").alias("_p"))
    first = Window.partitionBy(*keys).orderBy("_p", "description")
    kept = said.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= most)
    return kept.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "description"))), lambda x: x["description"]), " ").alias("description"))


def _slugged(extracted: DataFrame) -> DataFrame:
    return extracted.withColumn("id", T.slug("name")).where(T.plain_name("name") != "")


def merged_chunks(extracted: DataFrame) -> DataFrame:
    """(id, chunk_id, pos): the distinct chunks of each merged entity and where they were first extracted."""
    return _slugged(extracted).where("trim(chunk_id) <> ''").groupBy("id", "chunk_id").agg(F.min("pos").alias("pos"))


def resolve_relations(relations: DataFrame, extracted: DataFrame) -> DataFrame:
    """Relations whose both names are entities of the same chunk: adds source and target slugs, drops self relations."""
    known = extracted.select("chunk_id", T.plain_name("name").alias("_name"), T.slug("name").alias("_id")).where("_name <> ''").distinct()
    a = known.select("chunk_id", F.col("_name").alias("_a"), F.col("_id").alias("source"))
    b = known.select("chunk_id", F.col("_name").alias("_b"), F.col("_id").alias("target"))
    named = relations.withColumn("_a", T.plain_name("source_name")).withColumn("_b", T.plain_name("target_name"))
    return named.join(a, ["chunk_id", "_a"]).join(b, ["chunk_id", "_b"]).where("source <> target").drop("_a", "_b")


def relation_type(x) -> Column:
    """Upper-case relation type; RELATED_TO for null and blank."""
    t = F.upper(T.strip(x))
    return F.when(t.isNull() | (t == ""), "RELATED_TO").otherwise(t)


def merge_relations(relations: DataFrame) -> DataFrame:
    """(source, target, type, weight): directed relations of one type, with their number."""
    return relations.groupBy("source", "target", relation_type("type").alias("type")).agg(F.count("*").alias("weight"))


def told_relations(relations: DataFrame) -> DataFrame:
    """(source, target, type, pos, description): the descriptions of relations as rows, in the order of their arrays."""
    return relations.select("source", "target", relation_type("type").alias("type"), F.posexplode("descriptions").alias("pos", "description"))


def described_relations(relations: DataFrame) -> DataFrame:
    """`merge_relations` with the first six distinct descriptions and the number of distinct chunks: adds (description,
    chunk_count). `relations` has descriptions and chunk_ids as arrays; chunks stay rows (`relation_chunks`). A relation
    with a null end counts, but is told nothing about."""
    keys = ["source", "target", "type"]
    merged = merge_relations(relations)
    texts = first_descriptions(told_relations(relations), keys)
    counts = relation_chunks(relations).groupBy(*keys).agg(F.count("*").alias("chunk_count"))
    both = merged.join(texts, keys, "left").join(counts, keys, "left")
    return both.select(*keys, "weight", F.coalesce("description", F.lit("")).alias("description"), F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"))


def relation_chunks(relations: DataFrame) -> DataFrame:
    """(source, target, type, chunk_id, pos): the distinct chunks of each merged relation and their first place."""
    rows = relations.select("source", "target", relation_type("type").alias("type"), F.posexplode("chunk_ids").alias("pos", "chunk_id"))
    return rows.where("trim(chunk_id) <> ''").groupBy("source", "target", "type", "chunk_id").agg(F.min("pos").alias("pos"))


def collapsed_descriptions(relations: DataFrame) -> DataFrame:
    """(src, dst, description): what the relations of an undirected pair say, the first six distinct descriptions."""
    ends = told_relations(relations).where("source is not null and target is not null and source <> target")
    return first_descriptions(ends.select(F.least("source", "target").alias("src"), F.greatest("source", "target").alias("dst"), "pos", "description"), ["src", "dst"])


def collapse(relations: DataFrame) -> DataFrame:
    """(src, dst, weight, types): undirected pairs with summed weights and their distinct types; self loops drop out."""
    ends = relations.where("source is not null and target is not null and source <> target")
    return ends.groupBy(F.least("source", "target").alias("src"), F.greatest("source", "target").alias("dst")).agg(
        F.sum(F.coalesce("weight", F.lit(0)).cast("bigint")).alias("weight"), F.array_join(F.array_sort(F.collect_set(relation_type("type"))), ",").alias("types")
    )


def weighted_degree(links: DataFrame) -> DataFrame:
    """(node, degree, neighbours): summed weights over both directions."""
    both = links.select(F.col("src").alias("node"), "weight").union(links.select("dst", "weight"))
    return both.groupBy("node").agg(F.sum("weight").alias("degree"), F.count("*").alias("neighbours"))


def induced(links: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with both ends in one group: `members` has (node, group); adds the group."""
    a = members.select(F.col("node").alias("src"), F.col("group").alias("_ga"))
    b = members.select(F.col("node").alias("dst"), F.col("group").alias("_gb"))
    return links.join(a, "src").join(b, "dst").where("_ga = _gb").withColumn("group", F.col("_ga")).drop("_ga", "_gb")


def neighbour_chunks(seeds: DataFrame, links: DataFrame, held: DataFrame, neighbours: int = 5, chunks: int = 20) -> DataFrame:
    """(seed, neighbour, weight, source, chunk_id): the chunks of each seed's heaviest neighbours.

    Neighbours are cut to the top few per seed before their chunks are joined, so a hub costs no more than others;
    chunks are taken in the string order of their keys. Both are top-k of the feature itself.
    """
    both = links.select(F.col("src").alias("seed"), F.col("dst").alias("neighbour"), "weight").union(links.select("dst", "src", "weight"))
    near = both.join(seeds.select("seed").distinct(), "seed", "left_semi")
    top = Window.partitionBy("seed").orderBy(F.desc("weight"), "neighbour")
    near = near.withColumn("_r", F.row_number().over(top)).where(F.col("_r") <= neighbours).drop("_r")
    wanted = near.select("neighbour").distinct()
    own = held.select(F.col("node_id").alias("neighbour"), "source", "chunk_id").distinct().join(wanted, "neighbour", "left_semi")
    by_key = Window.partitionBy("neighbour").orderBy(T.chunk_key("source", "chunk_id"))
    own = own.withColumn("_r", F.row_number().over(by_key)).where(F.col("_r") <= chunks).drop("_r")
    return near.join(own, "neighbour").select("seed", "neighbour", "weight", "source", "chunk_id")


def within_hops(seeds: DataFrame, links: DataFrame, hops: int) -> DataFrame:
    """(node, hop): nodes reached from the seeds in at most `hops` steps, with the least number of steps."""
    both = links.select("src", "dst").union(links.select("dst", "src")).distinct()
    reached = seeds.select("node").distinct().withColumn("hop", F.lit(0))
    frontier = reached
    for hop in range(1, hops + 1):
        found = frontier.join(both, frontier["node"] == both["src"]).select(F.col("dst").alias("node")).distinct()
        frontier = found.join(reached, "node", "left_anti").withColumn("hop", F.lit(hop))
        reached = reached.unionByName(frontier)
    return reached


class ArticleCleaner:
    """The default cleaner of entity names, a generator of JSON: a name without its article stands for both if the batch
    has it; names without a letter are removed."""

    def generate(self, prompts) -> list[str]:
        import json
        import re

        out = []
        for p in prompts:
            given = json.loads(p.split("INPUT:", 1)[1])
            names = {e["name"] for e in given}
            groups: dict[str, dict] = {}
            removed = []
            for e in given:
                if not re.search(r"[^\W\d_]", e["name"]):
                    removed.append(e["name"])
                    continue
                plain = re.sub("^(?:the|a|an) ", "", e["name"])
                name = plain if plain in names else e["name"]
                own = groups.setdefault(name, {"name": name, "type": e["current_type"], "aliases": []})
                if e["name"] == name and name not in own["aliases"]:
                    own["type"] = e["current_type"]
                own["aliases"] = sorted({*own["aliases"], e["name"]})
            out.append(json.dumps({"entities": list(groups.values()), "removed_entities": removed}))
        return out


_CLEANED = "entities array<struct<name string, type string, aliases array<string>>>, removed_entities array<string>"


def clean_entities(nodes: DataFrame, model=None, batch: int = 25, attempts: int = 3) -> DataFrame:
    """(old_id, name, label, removed): what a model makes of entity names, batch by batch in the order of node ids.

    The model gets each batch as JSON and replies with canonical names, their labels and aliases, and names to remove. A
    canonical name must be a name of the batch, a label one of LABELS, an alias a name of the batch; what breaks this is
    ignored. An alias named twice goes with the last one. Names that the reply leaves out, and batches without a valid
    reply after `attempts`, have no row and stay as they are.
    """
    from braidlake.functions.models import asked
    from braidlake.runtime import checkpointed, numbered

    rows = numbered(nodes.select("node_id", "name", "label"), ["node_id"], "_at").withColumn("batch", F.floor(F.col("_at") / F.lit(batch)))
    rows = checkpointed(rows.withColumn("name", T.normal_entity("name")))
    given = F.transform(F.array_sort(F.collect_list(F.struct("_at", "name", "label"))), lambda x: F.struct(x["name"].alias("name"), x["label"].alias("current_type")))
    prompts = rows.groupBy("batch").agg(F.concat(F.lit("Give canonical names, labels and aliases of these entities as JSON.\nINPUT:"), F.to_json(given)).alias("prompt"))
    valid = lambda reply: _is_object(reply, ("entities",))
    replies = checkpointed(prompts.select("batch", F.from_json(T.json_object(asked("prompt", model or ArticleCleaner(), valid, attempts=attempts)), _CLEANED).alias("r")).where("r is not null"))
    names = rows.select("batch", F.col("name").alias("_name")).distinct()
    items = replies.select("batch", F.posexplode("r.entities").alias("_pos", "e")).select("batch", "_pos", T.normal_entity("e.name").alias("_name"), F.upper(T.strip("e.type")).alias("label"), "e.aliases")
    known = items.where(F.col("label").isin(*LABELS)).join(names, ["batch", "_name"], "left_semi")
    aliases = known.select("batch", "_pos", "label", F.col("_name").alias("_new"), F.explode("aliases").alias("_alias")).withColumn("_name", T.normal_entity("_alias"))
    last = aliases.groupBy("batch", "_name").agg(F.max_by(F.struct("_new", "label"), "_pos").alias("_to"))
    moved = rows.select("node_id", "batch", F.col("name").alias("_name")).join(last, ["batch", "_name"])
    mapped = moved.select(F.col("node_id").alias("old_id"), F.col("_to._new").alias("name"), F.col("_to.label").alias("label"), F.lit(False).alias("removed"))
    gone = replies.select("batch", F.explode("r.removed_entities").alias("_n")).select("batch", T.normal_entity("_n").alias("name")).distinct()
    removed = rows.join(gone, ["batch", "name"]).select(F.col("node_id").alias("old_id"), "name", "label", F.lit(True).alias("removed"))
    return mapped.join(removed.select("old_id"), "old_id", "left_anti").unionByName(removed)


def _is_object(reply: str | None, keys: tuple[str, ...]) -> bool:
    """Whether a reply holds a JSON object with lists under the keys."""
    import json

    text = reply or ""
    try:
        found = json.loads(text[text.index("{") : text.rindex("}") + 1])
    except ValueError:
        return False
    return isinstance(found, dict) and all(isinstance(found.get(k), list) for k in keys)


class NameGraphWriter:
    """The default extractor of chunk graphs, a generator of JSON: runs of capitalised words, each related to the next."""

    def generate(self, prompts) -> list[str]:
        import json

        import regex

        out = []
        for p in prompts:
            found = regex.findall(NAME_RUN, p.split("TEXT:", 1)[1])
            names = list(dict.fromkeys(found))
            pairs = list(dict.fromkeys((a, b) for a, b in zip(found, found[1:]) if a != b))
            out.append(json.dumps({"entities": [{"name": n, "type": "ENTITY", "description": ""} for n in names], "relationships": [{"source": a, "target": b, "type": "NEXT_TO", "description": ""} for a, b in pairs]}))
        return out


_GRAPH = "entities array<struct<name string, type string, description string>>, relationships array<struct<source string, target string, type string, description string>>"


def extract_chunk_graph(chunks: DataFrame, chunk_id: str, text: str, model=None, most_entities: int = 12, most_relations: int = 18, attempts: int = 3) -> DataFrame:
    """(chunk_id, entities, relationships, error): a model's graph of each chunk, cut to the first entities and relations.

    A null or blank text has an empty graph; a chunk without a valid reply has empty arrays and an error, so that it can be
    asked for again (`unseen` over the chunks without one).
    """
    from braidlake.functions.models import asked

    rows = chunks.select(F.col(chunk_id).alias("chunk_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    valid = lambda reply: _is_object(reply, ())
    prompt = F.concat(F.lit("Extract a graph as JSON: entities and relationships.\nTEXT:"), "_text")
    graph = F.from_json(T.json_object(asked(prompt, model or NameGraphWriter(), valid, attempts=attempts)), _GRAPH)
    read = rows.withColumn("_g", graph)
    first = lambda name, n: F.slice(F.coalesce(F.col(f"_g.{name}"), F.array().cast(read.schema["_g"].dataType[name].dataType)), 1, n).alias(name)
    return read.select("chunk_id", first("entities", most_entities), first("relationships", most_relations), F.when(F.col("_g").isNull(), "no valid reply").alias("error"))
