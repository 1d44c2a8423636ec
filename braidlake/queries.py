"""Queries of the core operators over whole tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from braidlake.functions import models
from braidlake.functions import text as T
from braidlake.functions import vectors as V
from braidlake.operators import chat, chunking, community, entities, evaluation, graph, judging, search
from braidlake.plans import ask, index
from braidlake.runtime import checkpointed, may_hold, numbered, ranked, read_table, spread
from braidlake.sources.store import replaced_by_source
from braidlake.streaming.ingest import event_counts

Query = Callable[[SparkSession, str], DataFrame]
_ALL: dict[str, Query] = {}


def query(f: Query) -> Query:
    _ALL[f.__name__] = f
    return f


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks, one row per key. Keys are counted in narrow rows first; only texts of keys that may repeat are shuffled."""
    rows = read_table(spark, d, "chunks").select("source", "chunk_id", "text").where("source is not null and chunk_id is not null")
    key = F.xxhash64("source", "chunk_id")
    repeated = may_hold(rows.groupBy("source", "chunk_id").agg(F.count("*").alias("n")).where("n > 1").select(key.alias("h")), "h", 16)
    return spread(rows.where(~repeated(key))).unionByName(rows.where(repeated(key)).dropDuplicates(["source", "chunk_id"]))


def _links(spark: SparkSession, d: str) -> DataFrame:
    return entities.collapse(read_table(spark, d, "v2_relationships").distinct())


def _held(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "entity_chunks").dropna().distinct()


@query
def flagship(spark: SparkSession, d: str) -> DataFrame:
    """The best ten documents for each held-out question."""
    docs, asked = read_table(spark, d, "documents"), read_table(spark, d, "eval_items")
    return search.bm25_topk(docs, "doc_id", "text", asked, "item_id", "question", 10).select("query_id", "doc_id", F.round("score", 5).alias("score"), "rank")


# Text and chunks


@query
def parse_blocks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.parse_blocks(read_table(spark, d, "files").select("id", "text").distinct(), "id", "text")


@query
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return chunking.clean_blocks(chunking.parse_blocks(read_table(spark, d, "files").select("id", "text").distinct(), "id", "text"))


@query
def chunk_words(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_words(read_table(spark, d, "documents"), ["doc_id"], "text", 100, 20)


@query
def chunk_words_numbered(spark: SparkSession, d: str) -> DataFrame:
    files = read_table(spark, d, "files").select("id", "text").distinct().withColumnRenamed("id", "file_id")
    return chunking.chunk_words_numbered(files, ["file_id"], "text", 100, 20).select("id", "file_id", "window", "text")


@query
def chunk_with_offsets(spark: SparkSession, d: str) -> DataFrame:
    files = read_table(spark, d, "files").select("id", "text").distinct()
    return chunking.chunk_with_offsets(files, "id", "text", 120, 20).select(F.col("source").alias("id"), "chunk_id", "text", "char_start", "char_end", "token_count")


@query
def tokenize_counts(spark: SparkSession, d: str) -> DataFrame:
    tokens = read_table(spark, d, "documents").select("doc_id", T.tokens("text").alias("t"))
    return tokens.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_terms"))


@query
def dedup_signature(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents").select("doc_id", T.short_hash(T.signature("text")).alias("signature")).where("signature is not null")
    return docs.groupBy("signature").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query
def dedup_hits(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "messages").select("session_id", "id", "content", "created_at").distinct().where("content is not null")
    return search.first_by_key(rows, ["session_id", "content"], ["created_at", "id"]).select("session_id", "id")


@query
def entity_names(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "v2_entities").select("id", "name", "type", "descriptions").distinct()
    return rows.select("id", T.normal_entity("name").alias("normal"), T.plain_name("name").alias("plain"), T.slug("name").alias("slug"), T.valid_entity("name").alias("valid"), T.node_id(F.coalesce("type", F.lit("ORG")), T.normal_entity("name")).alias("node_id"), T.short_hash("name").alias("hash"), T.description("descriptions").alias("description"))


@query
def json_extract(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "messages").select("id", T.json_object("metadata").alias("m")).where("m is not null").distinct()
    parsed = rows.select("id", F.from_json("m", "mode string, retrieval_query string, num_hits int, communities_used int").alias("j"))
    return parsed.select("id", "j.mode", "j.num_hits", "j.communities_used")


@query
def event_props(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "events").select("event_type", F.from_json("props", "k int").alias("j"), T.number_or(F.get_json_object("props", "$.k"), 1.0).alias("k"))
    return rows.groupBy("event_type").agg(F.count("j.k").alias("n"), F.sum("k").alias("total"))


@query
def append_sources(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "predictions").where("error is null and generated_answer is not null").select("id", "generated_answer", "source").distinct()
    marked = rows.select(F.col("id").alias("query_id"), F.concat("generated_answer", F.lit(" [1][2, 3] [Source: a.txt] .")).alias("answer"))
    hits = rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), "source")
    return chat.with_sources(marked, hits)


@query
def strip_html(spark: SparkSession, d: str) -> DataFrame:
    """Documents without tags, with single blanks."""
    docs = read_table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", T.clean("text", citations=False).alias("text"))


@query
def chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    """Chunks, words and characters of each source."""
    rows = _chunks(spark, d).select("source", "chunk_id", F.size(T.word_array("text")).alias("words"), F.length("text").alias("chars"))
    return rows.groupBy("source").agg(F.count("*").alias("chunks"), F.sum("words").alias("words"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"), F.max("words").alias("most_words"))


@query
def text_functions(spark: SparkSession, d: str) -> DataFrame:
    """Scalar functions over the messages: white space, keys, answers in tags, names from titles, safe folders."""
    rows = read_table(spark, d, "messages").select("id", "session_id", "role", "content").distinct()
    tagged = F.concat(F.lit("<thinking>x</thinking> <answer>"), F.coalesce("content", F.lit("")), F.lit("</answer>"))
    loose = F.concat(F.lit("<Thinking>a b</thinking>"), F.coalesce("content", F.lit("")))
    lists = F.array("content", F.lit(" x "), F.lit("  "))
    return rows.select(
        "id", T.collapse("content").alias("collapsed"), T.substring_count("content", F.lit("the")).alias("parts"), T.document_key("role", "id", "content").alias("key"), T.answer_of(tagged).alias("tagged"), T.answer_of(loose).alias("loose"),
        T.source_name("role", "content").alias("source_name"), F.array_join(T.filled(lists), "|").alias("filled"), T.safe_folder("session_id").alias("safe"), T.citation(F.lit("C"), "role", "session_id").alias("citation"),
        T.excerpt(F.lit("C"), F.lit("s"), F.lit(None), "content", 20).alias("excerpt"),
    )


@query
def mention_counts(spark: SparkSession, d: str) -> DataFrame:
    """How often each canonical entity is named as whole words in each chunk that holds it."""
    chunks = _chunks(spark, d)
    built = index.build_graph(chunks)
    held = built["entity_chunks"].join(built["nodes"].select("node_id", "name"), "node_id").join(chunks, ["source", "chunk_id"])
    return held.select("node_id", "source", "chunk_id", T.mention_count(T.collapse("text"), "name").alias("hits"))


@query
def citations(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "documents").select("doc_id", F.concat(F.lit("see ["), F.format_string("CHUNK-%06d", F.col("doc_id") % 1000), F.lit("] and [CHUNK-000007], [CHUNK-12]")).alias("answer"))
    cited = rows.select("doc_id", F.explode(T.cited_chunks("answer")).alias("chunk_id"))
    return cited.groupBy("chunk_id").agg(F.count("*").alias("n"))


# Search


@query
def bm25_corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    terms, _ = search.corpus_stats(read_table(spark, d, "documents"), "doc_id", "text")
    return terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    docs, asked = read_table(spark, d, "documents"), read_table(spark, d, "eval_items")
    return search.bm25_topk(docs, "doc_id", "text", asked, "item_id", "question").select("query_id", "doc_id", F.round("score", 5).alias("score"), "rank")


@query
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    vectors = read_table(spark, d, "embeddings")
    found = search.dense_topk(vectors, "vec_id", "embedding", vectors.where("vec_id % 20 = 0"), "vec_id", "embedding")
    return found.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query
def cell_topk(spark: SparkSession, d: str) -> DataFrame:
    """The approximate counterpart of `dense_topk`: 24 cells, 17 of them asked for, since these vectors hardly cluster."""
    vectors = read_table(spark, d, "embeddings")
    centres = search.fit_cells(vectors, "embedding", 24)
    assigned = search.assign_cells(vectors, "vec_id", "embedding", centres)
    found = search.cell_topk(assigned, centres, vectors.where("vec_id % 20 = 0"), "vec_id", "embedding", 20, 17)
    return found.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query
def dense_topk_batch(spark: SparkSession, d: str) -> DataFrame:
    """Each label's centre as a question: the nearest vectors of the whole table."""
    vectors = read_table(spark, d, "embeddings")
    parts = vectors.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("x"))
    centres = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("centre"))
    found = search.dense_topk(vectors, "vec_id", "embedding", centres, "label", "centre", 10)
    return found.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query
def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    """Dense and BM25 rankings of documents for the held-out questions; a vector belongs to the document or item of its number."""
    vectors = read_table(spark, d, "embeddings")
    docs, items = read_table(spark, d, "documents"), read_table(spark, d, "eval_items")
    asked = items.select("item_id", "question").join(vectors.withColumnRenamed("vec_id", "item_id"), "item_id")
    own = vectors.join(docs.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    dense = search.dense_topk(own, "vec_id", "embedding", asked, "item_id", "embedding")
    sparse = search.bm25_topk(docs, "doc_id", "text", asked, "item_id", "question")
    return search.fuse(dense, sparse, top=20).select("query_id", "doc_id", F.round("score", 9).alias("score"), "rank", "dense_rank", "sparse_rank")


@query
def vector_functions(spark: SparkSession, d: str) -> DataFrame:
    v = read_table(spark, d, "embeddings").select("vec_id", "embedding")
    pairs = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")
    return pairs.select("vec_id", F.round(V.dot("embedding", "other"), 4).alias("dot"), F.round(V.cosine("embedding", "other"), 4).alias("cosine"), F.round(V.clamp(V.cosine("embedding", "other")), 4).alias("clamped"), F.round(V.answer_similarity("embedding", "other"), 4).alias("similarity"), F.round(V.norm(V.unit("embedding")), 4).alias("length"))


# Entities and graph


@query
def entity_mentions(spark: SparkSession, d: str) -> DataFrame:
    return entities.mentions(_chunks(spark, d))


@query
def node_stats(spark: SparkSession, d: str) -> DataFrame:
    return entities.node_stats(entities.mentions(_chunks(spark, d)))


@query
def cooccurrence_edges(spark: SparkSession, d: str) -> DataFrame:
    return entities.edges(entities.edge_chunks(entities.mentions(_chunks(spark, d))))


@query
def prune_graph(spark: SparkSession, d: str) -> DataFrame:
    found = entities.mentions(_chunks(spark, d))
    return entities.prune(entities.node_stats(found), entities.edges(entities.edge_chunks(found)), 3, 2)[1]


@query
def canonicalize_entities(spark: SparkSession, d: str) -> DataFrame:
    return index.build_graph(_chunks(spark, d))["nodes"]


@query
def canonicalize_edges(spark: SparkSession, d: str) -> DataFrame:
    return index.build_graph(_chunks(spark, d))["edges"]


@query
def top_entities(spark: SparkSession, d: str) -> DataFrame:
    nodes = entities.node_stats(entities.mentions(_chunks(spark, d)))
    return nodes.orderBy(F.desc("mention_count"), "node_id").limit(25).select("node_id", "mention_count")


@query
def merge_entities(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "v2_entities").select("id", "name", "type", "descriptions", "chunk_ids").distinct()
    place = lambda i: F.concat("id", F.format_string("|%04d", i))
    none = F.lit(None).cast("string")
    plain = rows.select(F.col("id").alias("pos"), "name", "type", none.alias("description"), none.alias("chunk_id"))
    said = rows.select("id", "name", "type", F.posexplode("descriptions").alias("i", "description")).select(place(F.col("i")).alias("pos"), "name", "type", "description", none.alias("chunk_id"))
    held = rows.select("id", "name", "type", F.posexplode("chunk_ids").alias("i", "chunk_id")).select(place(F.col("i")).alias("pos"), "name", "type", none.alias("description"), "chunk_id")
    return entities.merge_entities(plain.unionByName(said).unionByName(held))


@query
def merge_relationships(spark: SparkSession, d: str) -> DataFrame:
    return entities.described_relations(read_table(spark, d, "v2_relationships").distinct())


@query
def resolve_relations(spark: SparkSession, d: str) -> DataFrame:
    found = entities.mentions(_chunks(spark, d)).withColumn("chunk_key", T.chunk_key("source", "chunk_id"))
    after = found.select("chunk_key", "sent_id", (F.col("pos") - 1).alias("pos"), F.col("name").alias("target_name"))
    relations = found.select("chunk_key", "sent_id", "pos", F.col("name").alias("source_name")).join(after, ["chunk_key", "sent_id", "pos"]).select(F.col("chunk_key").alias("chunk_id"), "source_name", "target_name", F.lit(" ").alias("type"))
    known = found.select(F.col("chunk_key").alias("chunk_id"), "name").distinct()
    return entities.merge_relations(entities.resolve_relations(relations, known))


@query
def collapse_graph(spark: SparkSession, d: str) -> DataFrame:
    return _links(spark, d)


@query
def weighted_degree(spark: SparkSession, d: str) -> DataFrame:
    return entities.weighted_degree(_links(spark, d))


@query
def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    links = _links(spark, d)
    nodes = read_table(spark, d, "v2_entities").agg(F.count_distinct("id").alias("nodes"))
    parts = _components(spark, d).agg(F.count_distinct("group").alias("communities"))
    both = links.agg(F.count("*").alias("edges")).withColumn("nodes", nodes.scalar()).withColumn("communities", parts.scalar())
    return both.select("nodes", "edges", "communities", V.density("nodes", "edges").alias("density"))


@query
def graph_view(spark: SparkSession, d: str) -> DataFrame:
    links = _links(spark, d)
    top = entities.weighted_degree(links).orderBy(F.desc("degree"), "node").limit(20).select("node", F.lit(0).alias("group"))
    return entities.induced(links, top).select("src", "dst", "weight").orderBy(F.desc("weight"), "src", "dst")


@query
def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The nodes that edges of at least twice the mean weight connect."""
    links = _links(spark, d)
    mean = links.agg(F.avg("weight").alias("w"))
    return graph.endpoints(links.where(F.col("weight") >= 2 * mean.scalar()))


@query
def trade_graph(spark: SparkSession, d: str) -> DataFrame:
    """A large bipartite graph: suppliers and customers linked by orders, and the suppliers' weighted degree."""
    orders = read_table(spark, d, "orders").select("o_orderkey", "o_custkey")
    lines = read_table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    pairs = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).groupBy("l_suppkey", "o_custkey").agg(F.count("*").alias("weight"))
    return pairs.groupBy("l_suppkey").agg(F.sum("weight").alias("degree"), F.count("*").alias("customers"))


@query
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    return graph.connected_components(_links(spark, d))


@query
def khop_neighbors(spark: SparkSession, d: str) -> DataFrame:
    """All nodes within two hops of the entities that stand in most chunks."""
    most = _held(spark, d).groupBy(F.col("node_id").alias("node")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "node").limit(5)
    return entities.within_hops(most, _links(spark, d), 2)


@query
def neighbor_expansion(spark: SparkSession, d: str) -> DataFrame:
    ids = read_table(spark, d, "v2_entities").select(F.col("id").alias("seed")).distinct()
    return entities.neighbour_chunks(ids, _links(spark, d), _held(spark, d))


def _components(spark: SparkSession, d: str) -> DataFrame:
    """(node, group): communities that both engines find alike."""
    return graph.connected_components(_links(spark, d)).select("node", F.col("component").alias("group"))


@query
def community_chunks(spark: SparkSession, d: str) -> DataFrame:
    held = _held(spark, d).withColumnRenamed("node_id", "node")
    rows = _components(spark, d).join(held, "node").select("group", "source", "chunk_id").distinct()
    first = Window.partitionBy("group").orderBy(T.chunk_key("source", "chunk_id"))
    ranked = rows.withColumn("k", F.row_number().over(first)).where("k <= 6")
    return ranked.select("group", T.chunk_key("source", "chunk_id").alias("chunk_key"), "k")


@query
def community_relationships(spark: SparkSession, d: str) -> DataFrame:
    return entities.induced(_links(spark, d), _components(spark, d)).select("group", "src", "dst", "weight")


def _named_graph(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The canonical graph of chunk mentions, its components as communities, and their chunks."""
    chunks = _chunks(spark, d)
    built = {k: checkpointed(v) for k, v in index.build_graph(chunks).items() if k != "mentions"}
    parts = graph.connected_components(built["edges"]).select("node", F.col("component").alias("community_id"))
    members = checkpointed(parts.join(built["nodes"].select(F.col("node_id").alias("node"), "mention_count"), "node"))
    held = built["entity_chunks"].withColumnRenamed("node_id", "node")
    homes = members.join(held, "node").select("community_id", "source", "chunk_id").distinct()
    return built | {"members": members, "held": held, "homes": homes, "chunks": chunks, "candidates": homes.join(chunks, ["source", "chunk_id"])}


@query
def entity_chunks_canonical(spark: SparkSession, d: str) -> DataFrame:
    return index.build_graph(_chunks(spark, d))["entity_chunks"]


@query
def rank_community_entities(spark: SparkSession, d: str) -> DataFrame:
    """Entities of each component by mentions, degree, chunks that name them and how often they do."""
    g = _named_graph(spark, d)
    matches = community.entity_matches(g["members"].select("community_id", "node"), g["homes"], g["chunks"])
    ranked = community.rank_entities(g["members"], g["edges"], checkpointed(matches))
    return ranked.select("community_id", "node", "coverage", "hits", "score", "rank")


@query
def community_ids(spark: SparkSession, d: str) -> DataFrame:
    """Components numbered by size and first member, their members ranked by mentions."""
    g = _named_graph(spark, d)
    return community.named_communities(g["members"].select("node", F.col("community_id").alias("label"), "mention_count"))


@query
def cover_scores(spark: SparkSession, d: str) -> DataFrame:
    """Base scores of the chunks of each component for its twenty most mentioned entities."""
    g = _named_graph(spark, d)
    ids = community.named_communities(g["members"].select("node", F.col("community_id").alias("label"), "mention_count"))
    leading = checkpointed(ids.select("community_id", "node", F.col("member_rank").alias("rank")))
    rows = g["candidates"].drop("community_id").join(g["held"].join(leading.select("community_id", "node"), "node").select("community_id", "source", "chunk_id").distinct(), ["source", "chunk_id"]).distinct()
    scored = community.scored_chunks(rows, leading)
    return scored.select("community_id", "source", "chunk_id", F.round("base", 4).alias("base"), F.size("held").alias("names"))


def _listed(spark: SparkSession, d: str) -> DataFrame:
    links, held = _links(spark, d), _held(spark, d).withColumnRenamed("node_id", "node")
    counts = held.groupBy("node").agg(F.count("*").alias("mention_count"))
    members = _components(spark, d).select(F.col("group").alias("community_id"), "node").join(counts, "node", "left").na.fill(0, ["mention_count"])
    nodes = read_table(spark, d, "v2_entities").select(F.col("id").alias("node")).distinct().join(links.select(F.col("src").alias("node")).union(links.select("dst")), "node", "left_anti")
    alone = nodes.select(F.col("node").alias("community_id"), "node").join(counts, "node", "left").na.fill(0, ["mention_count"])
    # The components of this graph are few and some hold most of it, so members are ranked over range partitions.
    all_ = members.unionByName(alone).withColumn("_m", -F.col("mention_count")).withColumn("_l", F.lower("node"))
    return community.community_list(ranked(all_, ["community_id"], ["_m", "_l", "node"], "member_rank"), held)


@query
def community_list(spark: SparkSession, d: str) -> DataFrame:
    return _listed(spark, d).withColumn("top_entities", F.array_join("top_entities", "|"))


@query
def community_view(spark: SparkSession, d: str) -> DataFrame:
    return community.community_view(_listed(spark, d)).withColumn("top_entities", F.array_join("top_entities", "|"))


def _v2(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Tables of the hierarchical index over v2_entities and v2_relationships; chunks are known by their string keys."""
    rows = read_table(spark, d, "v2_entities").select("id", "name", "type", "descriptions", "chunk_ids").distinct()
    relations = read_table(spark, d, "v2_relationships").distinct()
    own = rows.groupBy("id").agg(F.min(F.struct("name", F.coalesce("type", F.lit("")).alias("type"), T.description("descriptions").alias("description"))).alias("e")).select("id", "e.*")
    held = rows.select("id", F.posexplode("chunk_ids").alias("pos", "chunk_id")).groupBy("id", "chunk_id").agg(F.min("pos").alias("pos"))
    chunks = _chunks(spark, d).select(T.chunk_key("source", "chunk_id").alias("chunk_id"), "source", F.lit(None).cast("int").alias("page"), "text")
    return {"entities": own, "relations": entities.described_relations(relations), "entity_chunks": held, "relation_chunks": entities.relation_chunks(relations), "chunks": chunks, "links": _links(spark, d)}


@query
def report_context(spark: SparkSession, d: str) -> DataFrame:
    """The context of a report on each component: 25 entities, 35 relations, 12 excerpts."""
    t = _v2(spark, d)
    groups = _components(spark, d).select(F.col("group").alias("community_id"), "node")
    found = community.report_contexts(groups, t["links"], t["entities"], t["relations"], t["entity_chunks"], t["relation_chunks"], t["chunks"])
    return found.select("community_id", "context", F.array_join("chunk_ids", "|").alias("chunk_ids"))


@query
def community_reports(spark: SparkSession, d: str) -> DataFrame:
    t = _v2(spark, d)
    groups = _components(spark, d).select(F.col("group").alias("community_id"), "node")
    found = community.report_contexts(groups, t["links"], t["entities"], t["relations"], t["entity_chunks"], t["relation_chunks"], t["chunks"])
    return community.community_reports(found).select("community_id", "title", "summary", F.size("findings").alias("findings"), F.size("chunk_ids").alias("chunks"))


@query
def clean_entities(spark: SparkSession, d: str) -> DataFrame:
    """What the default cleaner makes of the mentioned entities, in batches of 25."""
    return entities.clean_entities(entities.node_stats(entities.mentions(_chunks(spark, d))))


@query
def chunk_graphs(spark: SparkSession, d: str) -> DataFrame:
    """The default extractor's graph of each chunk, 12 entities and 18 relations at most."""
    rows = _chunks(spark, d).select(T.chunk_key("source", "chunk_id").alias("chunk_id"), "text")
    found = entities.extract_chunk_graph(rows, "chunk_id", "text")
    pair = lambda r: F.concat(r["source"], F.lit(">"), r["target"])
    return found.select("chunk_id", F.array_join(F.transform("entities", lambda e: e["name"]), "|").alias("entities"), F.array_join(F.transform("relationships", pair), "|").alias("relations"), "error")


@query
def communities(spark: SparkSession, d: str) -> DataFrame:
    counts = _held(spark, d).groupBy(F.col("node_id").alias("node")).agg(F.count("*").alias("mention_count"))
    return community.communities(checkpointed(_links(spark, d)), counts)


@query
def hierarchical_communities(spark: SparkSession, d: str) -> DataFrame:
    nodes = read_table(spark, d, "v2_entities").select(F.col("id").alias("node")).distinct()
    return community.hierarchy(checkpointed(_links(spark, d)), nodes)


@query
def representative_chunks(spark: SparkSession, d: str) -> DataFrame:
    chunks = _chunks(spark, d)
    built = {k: checkpointed(v) for k, v in index.build_graph(chunks).items() if k != "mentions"}
    members = checkpointed(community.communities(built["edges"], built["nodes"].select(F.col("node_id").alias("node"), "mention_count")))
    ranked = members.select(F.col("community_id").cast("bigint").alias("community_id"), "node", F.col("member_rank").alias("rank"))
    held = built["entity_chunks"].withColumnRenamed("node_id", "node")
    candidates = checkpointed(ranked.join(held, "node").select("community_id", "source", "chunk_id").distinct())
    return community.representative_chunks(candidates, ranked, chunks=chunks)


@query
def community_summaries(spark: SparkSession, d: str) -> DataFrame:
    chunks = _chunks(spark, d)
    built = {k: checkpointed(v) for k, v in index.build_graph(chunks).items() if k != "mentions"}
    return index.community_tables(built, chunks)["community_summaries"]


def _retriever(spark: SparkSession, d: str) -> ask.Retriever:
    chunks = _chunks(spark, d)
    tables = {k: checkpointed(v) for k, v in index.build_graph(chunks).items() if k != "mentions"}
    tables |= {k: checkpointed(v) for k, v in index.community_tables(tables, chunks).items()}
    vectors = models.embed_column(chunks, "text", "embedding").select("source", "chunk_id", "embedding")
    return ask.Retriever(tables | {"chunks": chunks, "chunk_vectors": checkpointed(vectors)})


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), "question")


def _chunk_hits(spark: SparkSession, d: str, k: int) -> DataFrame:
    """BM25 hits of the held-out questions among the chunks, known by their keys."""
    chunks = _chunks(spark, d).withColumn("doc_id", T.chunk_key("source", "chunk_id"))
    return search.bm25_topk(chunks, "doc_id", "text", _questions(spark, d), "query_id", "question", k)


@query
def local_candidates(spark: SparkSession, d: str) -> DataFrame:
    """BM25 hits among the chunks and the chunks of graph neighbours, before any model ranks them."""
    chunks = _chunks(spark, d)
    tables = {k: checkpointed(v) for k, v in index.build_graph(chunks).items() if k != "mentions"}
    found = ask.Retriever(tables | {"chunks": chunks}).candidates(_questions(spark, d), checkpointed(_chunk_hits(spark, d, 20)))
    return found.select("query_id", "doc_id", F.round("score", 5).alias("score"), F.col("_o").alias("origin"), F.col("_r").alias("place"))


@query
def response_metadata(spark: SparkSession, d: str) -> DataFrame:
    """What the answers to the held-out questions were made from, by five BM25 hits each."""
    none = spark.createDataFrame([], "query_id bigint, community_id bigint")
    found = ask.response_metadata(_questions(spark, d), _chunk_hits(spark, d, 5), none, "local")
    return found.select("query_id", "mode", "num_hits", "communities_used", F.array_join("sources", "|").alias("sources"))


@query
def hybrid_query(spark: SparkSession, d: str) -> DataFrame:
    return _retriever(spark, d).hybrid(_questions(spark, d))


@query
def global_topk(spark: SparkSession, d: str) -> DataFrame:
    """The three nearest community summaries of each held-out question."""
    return _retriever(spark, d).global_summaries(_questions(spark, d))


def _explorer(spark: SparkSession, d: str) -> ask.Explorer:
    """An explorer over v2 tables; chunks are numbered as the ids that answers cite."""
    t = _v2(spark, d)
    ids = checkpointed(numbered(t["chunks"], ["chunk_id"], "_n").withColumn("id", F.format_string("CHUNK-%06d", "_n")))
    moved = ids.select("chunk_id", "id")
    renamed = lambda df: df.join(moved.withColumnRenamed("id", "_id"), "chunk_id").drop("chunk_id").withColumnRenamed("_id", "chunk_id")
    groups = _components(spark, d).select(F.col("group").alias("community_id"), "node")
    chunks = checkpointed(ids.select(F.col("id").alias("chunk_id"), "source", "page", "text"))
    held, told = checkpointed(renamed(t["entity_chunks"])), checkpointed(renamed(t["relation_chunks"]))
    contexts = community.report_contexts(groups, t["links"], t["entities"], t["relations"], held, told, chunks)
    reports = community.community_reports(contexts).select("community_id", "text")
    return ask.Explorer({"chunks": chunks, "entities": checkpointed(t["entities"]), "links": t["links"], "entity_chunks": held, "reports": checkpointed(reports)})


@query
def drift_search(spark: SparkSession, d: str) -> DataFrame:
    """The trace of exploratory search, to depth 2 with three follow-ups."""
    trace = _explorer(spark, d).search(_questions(spark, d))["trace"]
    return trace.select("query_id", "depth", "number", "question", "answer", F.array_join("chunk_ids", "|").alias("chunk_ids"))


@query
def drift_answers(spark: SparkSession, d: str) -> DataFrame:
    """Final answers of exploratory search with the number of sources they cite."""
    found = _explorer(spark, d).search(_questions(spark, d), depth=1)
    cited = found["sources"].groupBy("query_id").agg(F.count("*").alias("cited"))
    return found["answers"].join(cited, "query_id", "left").select("query_id", "answer", F.coalesce("cited", F.lit(0)).alias("cited"))


@query
def ask_answers(spark: SparkSession, d: str) -> DataFrame:
    """Every user's last question in each session, answered from the chunks by hybrid retrieval with the session's history."""
    messages, sessions = read_table(spark, d, "messages"), read_table(spark, d, "sessions")
    rows = messages.where((F.lower(T.strip("role")) == "user") & (T.strip("content") != "")).groupBy("session_id").agg(F.max_by("content", F.struct("created_at", "id")).alias("question"))
    owners = sessions.select(F.col("id").alias("session_id"), "user_id").distinct()
    asked = rows.join(owners, "session_id").select(F.col("session_id").alias("query_id"), "session_id", "user_id", "question")
    found = ask.converse(_retriever(spark, d), asked, messages, sessions)
    return found.select("query_id", "session_id", "answer", "metadata.mode", "metadata.num_hits", "metadata.communities_used", F.array_join("metadata.sources", "|").alias("sources"))


@query
def cited_sources(spark: SparkSession, d: str) -> DataFrame:
    """Chunks cited by texts that name the documents of the chunk before and after: unknown ids drop out."""
    ids = numbered(_chunks(spark, d), ["source", "chunk_id"], "n")
    chunks = checkpointed(ids.select(F.format_string("CHUNK-%06d", "n").alias("chunk_id"), "source", F.lit(None).cast("int").alias("page"), "n"))
    mark = lambda c: F.concat(F.lit("["), F.format_string("CHUNK-%06d", c), F.lit("]"))
    answered = chunks.select(F.col("n").alias("query_id"), F.concat(F.lit("See "), mark(F.col("n") + 1), F.lit(" and "), mark(F.abs(F.col("n") - 1)), F.lit(" or [CHUNK-1].")).alias("answer"))
    return ask.cited_sources(answered, chunks).select("query_id", "chunk_id", "source")


@query
def format_context(spark: SparkSession, d: str) -> DataFrame:
    """Context of each question of the predictions table: its evidence as one hit, its type as a summary."""
    rows = read_table(spark, d, "predictions").select("id", "source", "evidence", "question_type").distinct().withColumnRenamed("id", "query_id")
    hits = rows.where("evidence is not null").select("query_id", F.lit(1).alias("rank"), "source", F.col("evidence").alias("text"))
    notes = rows.where("question_type is not null").select("query_id", F.lit(1).alias("rank"), F.col("question_type").alias("summary"))
    return ask.format_context(rows.select("query_id"), hits, notes)


# Chat


@query
def chat_recent_history(spark: SparkSession, d: str) -> DataFrame:
    return chat.recent_history(read_table(spark, d, "messages")).select("session_id", "turn", "id", "role")


@query
def session_titles(spark: SparkSession, d: str) -> DataFrame:
    return chat.titles(read_table(spark, d, "messages"))


@query
def user_sessions(spark: SparkSession, d: str) -> DataFrame:
    """The sessions of the user who has most, the latest first."""
    sessions = read_table(spark, d, "sessions")
    top = sessions.distinct().groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").first()
    return chat.sessions_of(sessions, top["user_id"]).select("id", "title", "updated_at") if top else sessions.select("id", "title", "updated_at")


@query
def session_messages(spark: SparkSession, d: str) -> DataFrame:
    """All messages of every session that has a row, with their owner, in order."""
    sessions, messages = read_table(spark, d, "sessions"), read_table(spark, d, "messages")
    return chat.messages_of(sessions, messages).select("user_id", "session_id", "turn", "id")


@query
def deleted_session(spark: SparkSession, d: str) -> DataFrame:
    """What each table keeps when the first session is deleted with all that belongs to it."""
    sessions = read_table(spark, d, "sessions")
    first = sessions.orderBy("id").select("id", "user_id").first()
    kept = chat.delete_session(sessions, read_table(spark, d, "messages"), read_table(spark, d, "files"), first["id"] if first else -1, first["user_id"] if first else -1)
    count = lambda name, df: df.agg(F.lit(name).alias("tab"), F.count("*").alias("n"))
    return count("sessions", kept[0]).unionByName(count("messages", kept[1])).unionByName(count("files", kept[2]))


@query
def orphan_sessions(spark: SparkSession, d: str) -> DataFrame:
    both = read_table(spark, d, "messages").select("session_id").union(read_table(spark, d, "files").select("session_id"))
    return chat.orphans(both, read_table(spark, d, "sessions"))


@query
def sessions_per_user(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "sessions").distinct()
    return rows.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("updated_at").alias("last_update"))


# Evaluation


@query
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.stratified_sample(read_table(spark, d, "eval_items"), "item_id", ["corpus_name", "question_type"], 5).select("corpus_name", "question_type", "item_id")


def _answered(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "predictions").where("error is null").select("id", "question_type", "generated_answer", "gold_answer").distinct()


@query
def rouge1_recall(spark: SparkSession, d: str) -> DataFrame:
    return _answered(spark, d).select("id", F.round(evaluation.rouge1_recall("generated_answer", "gold_answer"), 6).alias("recall"))


@query
def rouge1_stemmed(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.with_stemmed_recall(_answered(spark, d), "generated_answer", "gold_answer", "recall").select("id", F.round("recall", 6).alias("recall"))


@query
def eval_report(spark: SparkSession, d: str) -> DataFrame:
    scores = _answered(spark, d).select("question_type", F.lit("rouge_score").alias("metric"), evaluation.rouge1_recall("generated_answer", "gold_answer").alias("score"))
    return evaluation.means_by_type(scores)


@query
def metric_routing(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "predictions").where("error is null").select("id", "question_type").distinct()
    return rows.join(evaluation.metric_table(spark), "question_type").groupBy("metric").agg(F.count("*").alias("n"))


@query
def judged_scores(spark: SparkSession, d: str) -> DataFrame:
    """Formulas of judged metrics over invented verdicts: the words of each answer, judged by their length."""
    rows = _answered(spark, d).select("id", evaluation.rouge_tokens("generated_answer").alias("a"))
    judged = rows.select("id", F.transform("a", lambda t: F.when(F.length(t) > 4, "yes").otherwise("0")).alias("v"), F.size("a").alias("n"))
    share = evaluation.mean_verdict("v")
    fact = evaluation.factuality(F.size(F.filter("v", lambda x: x == "yes")), F.col("n") % 3)
    return judged.select("id", F.round(share, 6).alias("share"), F.round(fact, 6).alias("factuality"), evaluation.relevance(F.col("n") % 4).alias("relevance"), F.round(evaluation.weighted(share, fact), 6).alias("correctness"))


def _to_judge(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "predictions").where("error is null").select("id", "question", "generated_answer", "gold_answer", "evidence").distinct()
    return rows.withColumn("contexts", F.array("evidence"))


@query
def faithfulness(spark: SparkSession, d: str) -> DataFrame:
    return judging.with_faithfulness(_to_judge(spark, d), "question", "generated_answer", "contexts", "score").select("id", F.round("score", 6).alias("score"))


@query
def coverage(spark: SparkSession, d: str) -> DataFrame:
    return judging.with_coverage(_to_judge(spark, d), "question", "gold_answer", "generated_answer", "score").select("id", F.round("score", 6).alias("score"))


@query
def context_recall(spark: SparkSession, d: str) -> DataFrame:
    return judging.with_context_recall(_to_judge(spark, d), "question", "contexts", "gold_answer", "score").select("id", F.round("score", 6).alias("score"))


@query
def context_relevance(spark: SparkSession, d: str) -> DataFrame:
    return judging.with_context_relevance(_to_judge(spark, d), "question", "contexts", "score").select("id", "score")


@query
def answer_correctness(spark: SparkSession, d: str) -> DataFrame:
    """Factuality alone (all weight on it), so that SQL can check it; the similarity of vectors has its own tests."""
    found = judging.with_correctness(_to_judge(spark, d), "question", "generated_answer", "gold_answer", "score", weights=(1.0, 0.0))
    return found.select("id", F.round("score", 6).alias("score"))


# Store and stream


@query
def replace_by_source(spark: SparkSession, d: str) -> DataFrame:
    old = _chunks(spark, d).select("source", "chunk_id", F.length("text").alias("n"))
    new = old.where(F.col("source").startswith("file-")).select("source", "chunk_id", F.lit(0).alias("n"))
    return replaced_by_source(old, new)


@query
def ingest_stats(spark: SparkSession, d: str) -> DataFrame:
    """Counts of an ingest of all files: texts, paragraphs before and after cleaning."""
    files = read_table(spark, d, "files").select(F.col("id").cast("string").alias("source"), "text").distinct()
    return index.ingest_stats(files, 120, 20).where("step <> 'new_chunks'")


@query
def chunk_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 200 byte-pair tokens over all files: how many per file, and the most tokens of one."""
    files = read_table(spark, d, "files").select("id", "text").distinct()
    found = chunking.chunk_by_tokens(files, "id", "text", 200, 40, models.BytePairCounter("/opt/tokenizers/byte_bpe_50k.tiktoken"))
    return found.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("chunks"), F.max("token_count").alias("most_tokens"))


@query
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    counted = event_counts(read_table(spark, d, "events"))
    return counted.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


def queries() -> dict[str, Query]:
    return dict(_ALL)


# SQL


def _strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{T.SPACE}+', ''), '{T.SPACE}+$', '')"


def _collapse(x: str) -> str:
    return _strip(f"regexp_replace({x}, '{T.SPACE}+', ' ', 'g')")


def _words(x: str) -> str:
    return f"case when coalesce({_collapse(x)}, '') = '' then [] else string_split({_collapse(x)}, ' ') end"


def _rouge(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(coalesce({x}, '')), '[^a-z0-9]+'), lambda t: t <> '')"


def _plain(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '{T.NOT_WORD}', ' ', 'g'))"


def _slug(x: str) -> str:
    s = f"regexp_replace(regexp_replace({_plain(x)}, '{T.NOT_WORD}', '_', 'g'), '^_+|_+$', '', 'g')"
    return f"case when {s} = '' then 'unnamed_entity' else substr({s}, 1, 120) end"


_TOKEN = T.TOKEN.replace("'", "''")


def _tokens(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), '{_TOKEN}')"


_FILES = "f as (select distinct id, regexp_replace(text, '\\r\\n?', chr(10), 'g') as text from files where text is not null)"
_BLOCKS = f"""with {_FILES}, b as (select id, list_filter(list_transform(regexp_split_to_array(text, '\\n[ \\t\\f]*\\n'),
lambda p: array_to_string(list_filter(list_transform(string_split(p, chr(10)), lambda l: {_strip('l')}), lambda l: l <> ''), ' ')), lambda p: p <> '') as ps from f),
bs as (select id, unnest(range(len(ps))) as i, ps from b)"""
_CHUNKS = "c as (select source, chunk_id, any_value(text) as text from chunks where source is not null and chunk_id is not null group by 1, 2)"
_LABEL = "case " + " ".join(f"when lower(regexp_split_to_array(raw, '[- ]')[-1]) in ({', '.join(repr(w) for w in ws)}) then '{label}'" for label, ws in reversed(list(entities.LABEL_BY_WORD.items()))) + " else 'PERSON' end"
_MENTIONS = f"""{_CHUNKS}, s as (select source, chunk_id, string_split(regexp_replace(text, '([.!?])[ \\t\\r\\n]+', '\\1' || chr(1), 'g'), chr(1)) as ss from c where text is not null),
se as (select source, chunk_id, unnest(range(len(ss))) as sent_id, ss from s), sx as (select source, chunk_id, sent_id, regexp_extract_all(ss[sent_id + 1], '{entities.NAME_RUN}') as ms from se),
mx as (select source, chunk_id, sent_id, unnest(range(len(ms))) as pos, ms from sx), my as (select source, chunk_id, sent_id, pos, ms[pos + 1] as raw from mx),
m as (select source, chunk_id, sent_id::int as sent_id, pos::int as pos, lower({_collapse('raw')}) as name, {_LABEL} as label from my where length({_collapse('raw')}) > 2),
n as (select label || '::' || name as node_id, name, label, count(*) as mention_count, count(distinct (source, chunk_id)) as chunk_count from m group by 1, 2, 3),
si as (select distinct source, chunk_id, sent_id, label || '::' || name as node_id from m),
ec as (select a.node_id as src, b.node_id as dst, a.source, a.chunk_id, count(*) as weight from si a join si b on a.source = b.source and a.chunk_id = b.chunk_id and a.sent_id = b.sent_id and a.node_id < b.node_id group by all),
e as (select src, dst, sum(weight)::bigint as weight, count(*) as chunk_count from ec group by 1, 2)"""
_CANON = f"""{_MENTIONS}, cm as (select *, regexp_replace(name, '^(?:the|a|an) ', '') as nn from n), cv as (select node_id, nn as name, label, label || '::' || nn as new_id, mention_count from cm where regexp_matches(nn, '\\p{{L}}')),
ch as (select new_id, count(*) as chunk_count from (select distinct new_id, source, chunk_id from (select distinct label || '::' || name as node_id, source, chunk_id from m) h join cv using (node_id)) group by 1)"""
_TYPE = f"case when coalesce({_strip('type')}, '') = '' then 'RELATED_TO' else upper({_strip('type')}) end"
_LINKS = f"""r as (select distinct * from v2_relationships), l as (select least(source, target) as src, greatest(source, target) as dst, sum(coalesce(weight, 0))::bigint as weight, array_to_string(list_sort(list(distinct {_TYPE})), ',') as types
from r where source <> target group by 1, 2), l2 as (select src, dst, weight from l union all select dst, src, weight from l), dg as (select src as node, sum(weight)::bigint as degree, count(*) as neighbours from l2 group by 1)"""
_HELD = "h as (select distinct node_id, source, chunk_id from entity_chunks where node_id is not null and source is not null and chunk_id is not null)"
_COMPONENTS = f"""with recursive {_LINKS}, reach as (select src as node, src as low from l2 union select l2.dst, reach.low from reach join l2 on l2.src = reach.node), cc as (select node, min(low) as component from reach group by 1), {_HELD}"""
_LISTED = _COMPONENTS + f""", mc as (select node_id as node, count(*) as n from h group by 1), mb as (select component as community_id, node from cc union all select distinct id, id from v2_entities where id not in (select node from cc)), rk as (select mb.*, row_number() over (partition by community_id order by coalesce(n, 0) desc, lower(node), node) as k from mb left join mc using (node)),
nc as (select community_id, count(distinct (source, chunk_id)) as num_chunks from mb join h on h.node_id = mb.node group by 1),
listed as (select community_id, count(*) as size, string_agg(node, '|' order by k) filter (where k <= 7) as top7, string_agg(node, '|' order by k) filter (where k <= 5) as top5, coalesce(any_value(num_chunks), 0) as num_chunks from rk left join nc using (community_id) group by 1)"""
_BM25 = f"""with t as (select doc_id, {_tokens('text')} as ts from documents), dl as (select doc_id, len(ts) as dl, ts from t where len(ts) > 0), g as (select count(*) as n, avg(dl) as avgdl from dl),
tf as (select doc_id, dl, term, count(*) as tf from (select doc_id, dl, unnest(ts) as term from dl) group by all), dfs as (select term, count(*) as df from tf group by 1),
raw as (select term, df, ln(n - df + 0.5) - ln(df + 0.5) as raw from dfs, g), idf as (select term, df, case when raw < 0 then 0.25 * (select avg(raw) from raw) else raw end as idf from raw),
q as (select item_id, term, count(*) as qtf from (select item_id, unnest({_tokens('question')}) as term from eval_items) group by all),
sc as (select item_id as query_id, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 9) as score from q join idf using (term) join tf using (term), g group by all),
rk as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from sc where score > 0)"""


_MERGED = f"""r as (select distinct source, target, {_TYPE} as type, descriptions, chunk_ids, weight, type as raw from v2_relationships),
rw as (select source, target, type, count(*) as weight from r group by 1, 2, 3),
rd as (select source, target, type, description, min(pos) as p from (select source, target, type, unnest(descriptions) as description, unnest(range(len(descriptions))) as pos from r) where trim(description) <> '' group by 1, 2, 3, 4),
rn as (select *, row_number() over (partition by source, target, type order by p, description) as k from rd), rt as (select source, target, type, string_agg(description, ' ' order by k) as description from rn where k <= 6 group by 1, 2, 3),
rc as (select source, target, type, chunk_id, min(pos) as pos from (select source, target, type, unnest(chunk_ids) as chunk_id, unnest(range(len(chunk_ids))) as pos from r) where trim(chunk_id) <> '' group by 1, 2, 3, 4), rk as (select source, target, type, count(*) as chunk_count from rc group by 1, 2, 3),
merged as (select rw.*, coalesce(description, '') as description, coalesce(chunk_count, 0) as chunk_count from rw left join rt using (source, target, type) left join rk using (source, target, type))"""


def _support(text: str, statement: str) -> str:
    """1 if at least half of the statement's tokens stand in the list of tokens."""
    own = _rouge(statement)
    return f"case when len({own}) > 0 and 2 * len(list_filter({own}, lambda t: list_contains({text}, t))) >= len({own}) then 1 else 0 end"


def _sentences(x: str) -> str:
    return f"list_filter(list_transform(string_split(regexp_replace(coalesce({x}, ''), '([.!?])[ \\t\\r\\n]+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, e' \\t\\r\\n')), lambda s: s <> '')"


_JUDGED = f"""with p as (select distinct id, question, generated_answer as a, gold_answer as g, evidence as e from predictions where error is null), j as (select id, question, {_strip("coalesce(a, '')")} as a, {_strip("coalesce(g, '')")} as g, coalesce(g, '') as raw, {_strip("coalesce(e, '')")} as e from p),
k as (select *, {_sentences('a')} as sa, {_sentences('g')} as sg, {_rouge('a')} as ta, {_rouge('raw')} as tg, {_rouge('e')} as te from j)"""


_CHUNK_BM25 = (
    _BM25.replace("with t as", "t as", 1).replace("from documents", "from (select source || '_' || chunk_id as doc_id, text from c)", 1)
)
_NAMED = f"""{_CANON}, nn as (select new_id as node, sum(mention_count)::bigint as mentions from cv group by 1), ce as (select least(a.new_id, b.new_id) as src, greatest(a.new_id, b.new_id) as dst from ec join cv a on a.node_id = src join cv b on b.node_id = dst where a.new_id <> b.new_id),
e2 as (select distinct src, dst from ce union select dst, src from ce), reach as (select src as node, src as low from e2 union select e2.dst, reach.low from reach join e2 on e2.src = reach.node), co as (select node, min(low) as part from reach group by 1),
held as (select distinct new_id as node, source, chunk_id from (select distinct label || '::' || name as node_id, source, chunk_id from m) h join cv using (node_id)),
mr as (select part, node, row_number() over (partition by part order by mentions desc, lower(node), node) as member_rank, count(*) over (partition by part) as size from co join nn using (node)),
pi as (select part, row_number() over (order by size desc, lower(node), node) - 1 as community_id from mr where member_rank = 1), ids as (select community_id, node, member_rank, size from mr join pi using (part))"""


_REPORT = f""", v as (select distinct id, name, coalesce(type, '') as type, coalesce(array_to_string(list_filter(list_distinct_ordered, lambda x: true)[1:6], ' '), '') as description from (select distinct id, name, type, list_filter(list_filter(descriptions, lambda x: x is not null and trim(x) <> ''), lambda x, i: list_position(list_filter(descriptions, lambda y: y is not null and trim(y) <> ''), x) = i) as list_distinct_ordered from v2_entities)),
en as (select id, min((name, type, description)) as e from v group by 1), {_MERGED.replace('r as (', 'r0 as (', 1).replace('from r)', 'from r0)').replace('from r group', 'from r0 group')},
sel as (select * from (select component, cc.node, row_number() over (partition by component order by coalesce(degree, 0) desc, cc.node) as k from cc left join dg using (node)) where k <= 25), se as (select component, k, node, e from sel join en on en.id = node),
el as (select component, string_agg('- ' || e[1] || ' [' || e[2] || ']: ' || e[3], chr(10) order by k) as t from se group by 1),
bt as (select *, row_number() over (partition by component order by weight desc, source, target, type) as k from (select a.component, m.*, a.e[1] as sn, b.e[1] as tn from merged m join se a on a.node = m.source join se b on b.node = m.target where a.component = b.component)), b35 as (select * from bt where k <= 35),
rl as (select component, string_agg('- ' || sn || ' --' || type || '--> ' || tn || ': ' || description, chr(10) order by k) as t from b35 group by 1),
ch as (select component, chunk_id, min((0, k, pos)) as place from (select component, k, unnest(chunk_ids) as chunk_id, unnest(range(len(chunk_ids))) as pos from se join (select distinct id, chunk_ids from v2_entities) q on q.id = node) group by 1, 2
union all select component, chunk_id, min((1, b35.k, pos)) from b35 join rc using (source, target, type) group by 1, 2),
cu as (select component, chunk_id, min(place) as place from ch group by 1, 2), c12 as (select * from (select *, row_number() over (partition by component order by place, chunk_id) as k from cu) where k <= 12),
ck as (select source || '_' || chunk_id as key, source, any_value(text) as text from chunks where source is not null and chunk_id is not null group by source, chunk_id),
xl as (select component, string_agg('[' || key || '] ' || source || chr(10) || substr(text, 1, 900), chr(10) || chr(10) order by k) as t from c12 join ck on key = chunk_id where text is not null group by 1), ci as (select component, string_agg(chunk_id, '|' order by k) as t from c12 group by 1)
"""


def _cosine(table: str, vector: str) -> str:
    return f"""select q.vec_id as query_id, v.vec_id as doc_id, round(greatest(0, least(1, coalesce(list_cosine_similarity({vector.format(a='q')}::double[], {vector.format(a='v')}::double[]), 0))), 9) as score
from {table} q, {table} v where q.vec_id % 20 = 0"""


def oracle_sql() -> dict[str, str]:
    bm25 = _BM25 + " select query_id, doc_id, round(score, 5) as score, rank from rk where rank <= "
    return {
        "flagship": bm25 + "10",
        "bm25_topk": bm25 + "20",
        "bm25_corpus_stats": _BM25 + " select term, df, round(idf, 6) as idf from idf",
        "parse_blocks": _BLOCKS + " select id, i::int as block_index, ps[i + 1] as text from bs",
        "clean_text": _BLOCKS
        + f""", x as (select id, i::int as block_index, {_strip("regexp_replace(regexp_replace(regexp_replace(regexp_replace(ps[i + 1], '" + T.HEADING + "', '\\1'), '" + T.HTML_TAG + "', ' ', 'g'), '" + T.NUMERIC_CITATION + "', ' ', 'g'), '" + T.HORIZONTAL + "', ' ', 'g')")} as text from bs)
select id, block_index, text from x where length(text) >= 3""",
        "chunk_words": f"""with w as (select doc_id, {_words('text')} as ws from documents), k as (select doc_id, ws, unnest(range(greatest(0, ceil((len(ws) - 100) / 80.0)::int) + 1)) as i from w where len(ws) > 0)
select doc_id, i::int as "window", (i * 80)::int as start, array_to_string(ws[i * 80 + 1:i * 80 + 100], ' ') as text from k""",
        "chunk_words_numbered": f"""with f as (select distinct id, text from files), w as (select id, {_words('text')} as ws from f), k as (select id, ws, unnest(range(greatest(0, ceil((len(ws) - 100) / 80.0)::int) + 1)) as i from w where len(ws) > 0)
select format('CHUNK-{{:06d}}', row_number() over (order by id, i) - 1) as id, id as file_id, i::int as "window", array_to_string(ws[i * 80 + 1:i * 80 + 100], ' ') as text from k""",
        "chunk_with_offsets": f"""with f as (select distinct id, {_strip('text')} as text from files where text is not null), w as (select id, text, regexp_extract_all(text, '\\S+\\s*') as rs from f where text <> ''),
p as (select id, text, rs, list_transform(rs, lambda r: length(r)) as ls, unnest(range(greatest(0, ceil((len(rs) - 120) / 100.0)::int) + 1)) as i from w),
b as (select id, text, rs, ls, i::int as chunk_id, i * 100 as s, least(120, len(rs) - i * 100) as n, coalesce(list_sum(ls[1:i * 100]), 0)::int as a from p),
z as (select *, (a + coalesce(list_sum(ls[s + 1:s + n - 1]), 0) + length(rtrim(rs[s + n], e' \\t\\r\\n\\f')))::int as e from b)
select id, chunk_id, substr(text, a + 1, e - a) as text, a as char_start, e as char_end, n::int as token_count from z""",
        "tokenize_counts": f"select doc_id, len(t)::int as n_tokens, len(list_distinct(t))::int as n_terms from (select doc_id, {_tokens('text')} as t from documents)",
        "dedup_signature": f"select substr(md5(regexp_replace(lower(text), '{T.NOT_WORD}', '', 'g')), 1, 10) as signature, min(doc_id) as doc_id, count(*) as copies from documents where text is not null group by 1",
        "dedup_hits": "select session_id, id from (select session_id, id, row_number() over (partition by session_id, content order by created_at nulls first, id) as r from (select distinct session_id, id, content, created_at from messages where content is not null)) where r = 1",
        "entity_names": f"""select distinct id, lower({_collapse('name')}) as normal, {_plain('name')} as plain, {_slug('name')} as slug, length(name) > 2 and not regexp_matches(name, '^[0-9][0-9.,%:/\\- ]*$') as valid, coalesce(type, 'ORG') || '::' || lower({_collapse('name')}) as node_id,
substr(md5(name), 1, 10) as hash, coalesce(array_to_string(list_filter(descriptions, lambda x: x is not null and trim(x) <> '')[1:6], ' '), '') as description from v2_entities""",
        "json_extract": "select distinct id, json_extract_string(m, '$.mode') as mode, json_extract_string(m, '$.num_hits')::int as num_hits, json_extract_string(m, '$.communities_used')::int as communities_used from (select id, nullif(regexp_extract(metadata, '(?s)(\\{.*\\})', 1), '') as m from messages) where m is not null",
        "event_props": "select event_type, count(try_cast(json_extract_string(props, '$.k') as int)) as n, sum(coalesce(try_cast(json_extract_string(props, '$.k') as double), 1.0)) as total from events group by 1",
        "citations": "select chunk_id, count(*) as n from (select doc_id, unnest(list_distinct([format('CHUNK-{:06d}', doc_id % 1000), 'CHUNK-000007'])) as chunk_id from documents) group by 1",
        "dense_topk": f"with s as ({_cosine('embeddings', '{a}.embedding')}), r as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from s) select query_id, doc_id, round(score, 6) as score, rank from r where rank <= 20",
        "rrf_fuse": _BM25.replace("with t as", f"with cosine as (select q.item_id as query_id, v.vec_id as doc_id, round(greatest(0, least(1, coalesce(list_cosine_similarity(e.embedding::double[], v.embedding::double[]), 0))), 9) as score from eval_items q join embeddings e on e.vec_id = q.item_id join embeddings v on v.vec_id in (select doc_id from documents)), t as", 1)
        + """, d as (select query_id, doc_id, row_number() over (partition by query_id order by score desc, doc_id) as dense_rank from cosine), s as (select query_id, doc_id, rank as sparse_rank from rk where rank <= 20 and query_id in (select vec_id from embeddings)),
j as (select coalesce(d.query_id, s.query_id) as query_id, coalesce(d.doc_id, s.doc_id) as doc_id, dense_rank, sparse_rank, coalesce(0.6::double / (60 + dense_rank), 0) + coalesce(0.4::double / (60 + sparse_rank), 0) as score from (select * from d where dense_rank <= 20) d full join s on d.query_id = s.query_id and d.doc_id = s.doc_id),
k as (select *, row_number() over (partition by query_id order by score desc, dense_rank nulls last, sparse_rank nulls last, doc_id) as rank from j) select query_id, doc_id, round(score, 9) as score, rank, dense_rank, sparse_rank from k where rank <= 20""",
        "dense_topk_batch": """with x as (select label, i, round(avg(embedding[i]::double), 6) as x from (select label, embedding, unnest(range(1, len(embedding) + 1)) as i from embeddings) group by 1, 2), c as (select label, list(x order by i) as centre from x group by 1),
s as (select label as query_id, vec_id as doc_id, round(greatest(0, least(1, coalesce(list_cosine_similarity(centre, embedding::double[]), 0))), 9) as score from c, (select vec_id, embedding from embeddings)), r as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from s) select query_id, doc_id, round(score, 6) as score, rank from r where rank <= 10""",
        "vector_functions": "with p as (select a.vec_id, a.embedding::double[] as x, b.embedding::double[] as y from embeddings a join embeddings b on b.vec_id = a.vec_id + 1), c as (select vec_id, list_dot_product(x, y) as d, coalesce(list_cosine_similarity(x, y), 0) as c, sqrt(list_dot_product(x, x)) as n from p) select vec_id, round(d, 4) as dot, round(c, 4) as cosine, round(greatest(0, least(1, c)), 4) as clamped, round((greatest(-1, least(1, c)) + 1) / 2, 4) as similarity, round(n / n, 4) as length from c",
        "entity_mentions": f"with {_MENTIONS} select source, chunk_id, sent_id, pos, name, label from m",
        "node_stats": f"with {_MENTIONS} select * from n",
        "cooccurrence_edges": f"with {_MENTIONS} select * from e",
        "prune_graph": f"with {_MENTIONS}, k as (select node_id from n where chunk_count >= 3) select * from e where weight >= 2 and src in (select node_id from k) and dst in (select node_id from k)",
        "canonicalize_entities": f"with {_CANON} select new_id as node_id, name, label, sum(mention_count)::bigint as mention_count, any_value(chunk_count) as chunk_count from cv join ch using (new_id) group by 1, 2, 3",
        "canonicalize_edges": f"with {_CANON}, x as (select least(a.new_id, b.new_id) as src, greatest(a.new_id, b.new_id) as dst, source, chunk_id, sum(weight) as weight from ec join cv a on a.node_id = src join cv b on b.node_id = dst where a.new_id <> b.new_id group by all) select src, dst, sum(weight)::bigint as weight, count(*) as chunk_count from x group by 1, 2",
        "top_entities": f"with {_MENTIONS} select node_id, mention_count from n order by mention_count desc, node_id limit 25",
        "merge_entities": f"""with v as (select distinct id as vid, name, type, descriptions, chunk_ids, {_slug('name')} as id from v2_entities where {_plain('name')} <> ''),
h as (select id, arg_min(name, vid) as name, first(type order by vid) as type from v group by 1), ds as (select id, description, min(vid || '|' || printf('%04d', i)) as p from (select id, vid, unnest(descriptions) as description, unnest(range(len(descriptions))) as i from v) where trim(description) <> '' group by 1, 2),
dn as (select *, row_number() over (partition by id order by p, description) as k from ds), dt as (select id, string_agg(description, ' ' order by k) as description from dn where k <= 6 group by 1), cs as (select id, count(distinct c) as chunk_count from (select id, unnest(chunk_ids) as c from v) where trim(c) <> '' group by 1)
select id, name, type, coalesce(description, '') as description, coalesce(chunk_count, 0) as chunk_count from h left join dt using (id) left join cs using (id)""",
        "merge_relationships": f"with {_MERGED} select * from merged",
        "resolve_relations": f"with {_MENTIONS}, p as (select {_slug('a.name')} as source, {_slug('b.name')} as target from m a join m b on a.source = b.source and a.chunk_id = b.chunk_id and a.sent_id = b.sent_id and b.pos = a.pos + 1) select source, target, 'RELATED_TO' as type, count(*) as weight from p where source <> target group by 1, 2",
        "collapse_graph": f"with {_LINKS} select * from l",
        "weighted_degree": f"with {_LINKS} select * from dg",
        "graph_stats": _COMPONENTS + ", x as (select (select count(distinct id) from v2_entities) as nodes, (select count(*) from l) as edges, (select count(distinct component) from cc) as communities) select nodes, edges, communities, case when nodes > 1 then round(2.0 * edges / (nodes * (nodes - 1.0)), 4)::double else 0 end as density from x",
        "graph_view": f"with {_LINKS}, t as (select node from dg order by degree desc, node limit 20) select src, dst, weight from l where src in (select node from t) and dst in (select node from t)",
        "graph_nodes": f"with {_LINKS}, x as (select src, dst from l where weight >= 2 * (select avg(weight) from l)) select src as node from x union select dst from x",
        "trade_graph": "with p as (select l_suppkey, o_custkey, count(*) as weight from lineitem join orders on l_orderkey = o_orderkey group by 1, 2) select l_suppkey, sum(weight)::bigint as degree, count(*) as customers from p group by 1",
        "connected_components": _COMPONENTS + " select node, component from cc",
        "khop_neighbors": f"with {_LINKS}, {_HELD}, s as (select node_id as node from h group by 1 order by count(*) desc, node_id limit 5), a as (select distinct dst as node from l2 where src in (select node from s) and dst not in (select node from s)), b as (select distinct dst as node from l2 where src in (select node from a) and dst not in (select node from a) and dst not in (select node from s)) select node, 0 as hop from s union all select node, 1 from a union all select node, 2 from b",
        "neighbor_expansion": f"with {_LINKS}, {_HELD}, n as (select src as seed, dst as neighbour, weight, row_number() over (partition by src order by weight desc, dst) as r from l2 where src in (select id from v2_entities)), k as (select *, row_number() over (partition by node_id order by source || '_' || chunk_id) as r from h) select seed, neighbour, weight, source, chunk_id from n join k on k.node_id = neighbour where n.r <= 5 and k.r <= 20",
        "community_chunks": _COMPONENTS + ", x as (select distinct component, source || '_' || chunk_id as chunk_key from cc join h on h.node_id = node), y as (select *, row_number() over (partition by component order by chunk_key) as k from x) select component as \"group\", chunk_key, k from y where k <= 6",
        "community_relationships": _COMPONENTS + ' select a.component as "group", src, dst, weight from l join cc a on a.node = src join cc b on b.node = dst where a.component = b.component',
        "entity_chunks_canonical": f"with {_CANON} select distinct new_id as node_id, source, chunk_id from (select distinct label || '::' || name as node_id, source, chunk_id from m) h join cv using (node_id)",
        "rank_community_entities": f"""with recursive {_CANON}, nn as (select new_id as node, name, sum(mention_count)::bigint as mentions from cv group by 1, 2), ce as (select least(a.new_id, b.new_id) as src, greatest(a.new_id, b.new_id) as dst, sum(weight)::bigint as weight from ec join cv a on a.node_id = src join cv b on b.node_id = dst where a.new_id <> b.new_id group by 1, 2),
e2 as (select src, dst, weight from ce union all select dst, src, weight from ce), reach as (select src as node, src as low from e2 union select e2.dst, reach.low from reach join e2 on e2.src = reach.node), co as (select node, min(low) as community_id from reach group by 1),
held as (select distinct new_id as node, source, chunk_id from (select distinct label || '::' || name as node_id, source, chunk_id from m) h join cv using (node_id)), ca as (select distinct community_id, source, chunk_id from co join held using (node)),
tx as (select community_id, source, chunk_id, ' ' || regexp_replace(lower({_collapse('text')}), '([^\\p{{L}}\\p{{N}}_])', '\\1\\1', 'g') || ' ' as t from ca join c using (source, chunk_id) where text is not null),
hi as (select co.community_id, co.node, len(regexp_extract_all(t, '[^\\p{{L}}\\p{{N}}_]' || regexp_escape(regexp_replace(name, '([^\\p{{L}}\\p{{N}}_])', '\\1\\1', 'g')) || '[^\\p{{L}}\\p{{N}}_]')) as n from co join nn using (node) join tx on tx.community_id = co.community_id where contains(t, regexp_replace(name, '([^\\p{{L}}\\p{{N}}_])', '\\1\\1', 'g'))),
hm as (select community_id, node, count(*) as coverage, sum(n)::bigint as hits from hi where n > 0 group by 1, 2), de as (select src as node, sum(weight) as degree from e2 group by 1),
x as (select co.community_id, co.node, coalesce(coverage, 0) as coverage, coalesce(hits, 0) as hits, round(ln(1 + mentions) + 1.5 * ln(1 + coalesce(degree, 0)) + 2.0 * coalesce(coverage, 0) + 0.5 * ln(1 + coalesce(hits, 0)), 6) as score from co join nn using (node) left join hm on hm.community_id = co.community_id and hm.node = co.node left join de on de.node = co.node)
select community_id, node, coverage, hits, score, row_number() over (partition by community_id order by score desc, lower(node), node) as rank from x""",
        "community_list": _LISTED + " select community_id, size, top7 as top_entities, num_chunks, 'No summary yet.' as summary from listed",
        "community_view": _LISTED + " select community_id, size, top5 as top_entities, num_chunks, 'No summary yet.' as summary from listed where size <> 1",
        "report_context": _COMPONENTS
        + _REPORT
        + """select g.component as community_id, 'ENTITIES' || chr(10) || coalesce(el.t, '') || chr(10) || chr(10) || 'RELATIONSHIPS' || chr(10) || coalesce(rl.t, '') || chr(10) || chr(10) || 'SOURCE EXCERPTS' || chr(10) || coalesce(xl.t, '') as context, coalesce(ci.t, '') as chunk_ids
from (select distinct component from cc) g left join el using (component) left join rl using (component) left join xl using (component) left join ci using (component)""",
        "community_reports": _COMPONENTS
        + _REPORT
        + """, tt as (select component, first(e[1] order by k) as title, 'Concerns ' || string_agg(e[1], ', ' order by k) filter (where k <= 5) || '.' as summary from se group by 1), fc as (select component, least(7, count(*))::int as findings from c12 join ck on key = chunk_id where text is not null group by 1), cc12 as (select component, count(*)::int as chunks from c12 group by 1)
select g.component as community_id, coalesce(title, g.component) as title, coalesce(summary, '') as summary, coalesce(findings, 0) as findings, coalesce(chunks, 0) as chunks from (select distinct component from cc) g left join tt using (component) left join fc using (component) left join cc12 using (component)""",
        "clean_entities": f"""with {_MENTIONS}, b as (select *, (row_number() over (order by node_id) - 1) // 25 as batch, regexp_replace(name, '^(?:the|a|an) ', '') as plain from n), w as (select batch, name, arg_min(label, node_id) as label from b group by 1, 2)
select node_id as old_id, coalesce(w.name, b.name) as name, coalesce(w.label, o.label) as label, false as removed from b left join w on w.batch = b.batch and w.name = b.plain left join w o on o.batch = b.batch and o.name = b.name where regexp_matches(b.name, '\\p{{L}}')
union all select node_id, name, label, true from b where not regexp_matches(name, '\\p{{L}}')""",
        "chunk_graphs": f"""with {_CHUNKS}, x as (select source || '_' || chunk_id as chunk_id, coalesce(regexp_extract_all(text, '{entities.NAME_RUN}'), []) as ms from c), y as (select chunk_id, ms, list_filter(list_transform(range(1, len(ms)), lambda i: ms[i] || '>' || ms[i + 1]), lambda p: split_part(p, '>', 1) <> split_part(p, '>', 2)) as ps from x)
select chunk_id, array_to_string(list_filter(ms, lambda v, i: list_position(ms, v) = i)[1:12], '|') as entities, array_to_string(list_filter(ps, lambda v, i: list_position(ps, v) = i)[1:18], '|') as relations, null::varchar as error from y""",
        "cited_sources": f"with {_CHUNKS}, x as (select source, row_number() over (order by source, chunk_id) - 1 as n from c), y as (select n as query_id, unnest(list_distinct([n + 1, abs(n - 1)])) as k from x) select query_id, printf('CHUNK-%06d', k) as chunk_id, source from y join x on x.n = k",
        "append_sources": f"""with p as (select distinct id, generated_answer, source from predictions where error is null and generated_answer is not null), q as (select id, source, generated_answer || ' [1][2, 3] [Source: a.txt] .' as x from p),
a as (select id, source, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_split_to_array(x, '(?im)^[ \\t]*#{{0,6}}[ \\t]*sources?[ \\t]*:?[ \\t]*$')[1], '(?:\\[[ \\t]*[0-9]+(?:[ \\t]*,[ \\t]*[0-9]+)*[ \\t]*\\])+', '', 'g'), '(?i)\\[[ \\t]*source[ \\t]*:[^\\]]+\\]', '', 'g'), '[ \\t]+([.,;:!?])', '\\1', 'g'), '[ \\t]{{2,}}', ' ', 'g') as t from q),
n as (select id, {_strip('t')} as t, regexp_replace(string_split({_strip("coalesce(source, '')")}, '/')[-1], '(?i)_[a-f0-9]{{8,64}}$', '') as name from a)
select id as query_id, case when name <> '' then t || chr(10) || chr(10) || '### Sources' || chr(10) || '- ' || name else t end as answer from n""",
        "strip_html": f"select doc_id, {_strip("regexp_replace(regexp_replace(regexp_replace(text, '" + T.HEADING + "', '\\1'), '" + T.HTML_TAG + "', ' ', 'g'), '" + T.HORIZONTAL + "', ' ', 'g')")} as text from documents where text is not null",
        "chunk_stats": f"with {_CHUNKS}, x as (select source, len({_words('text')}) as w, length(text) as n from c) select source, count(*) as chunks, sum(w)::bigint as words, coalesce(sum(n), 0)::bigint as chars, max(w)::int as most_words from x group by 1",
        "text_functions": f"""select distinct id, {_collapse('content')} as collapsed, ((length(content) - length(replace(content, 'the', ''))) / 3)::int as parts, case when role is not null and id is not null then role || '_' || id else content end as key,
{_strip("coalesce(content, '')")} as tagged, {_strip("coalesce(content, '')")} as loose, case when coalesce({_strip('role')}, '') in ('', '.', '..') then 'PastFile' else string_split({_strip('role')}, '/')[-1] end || '_' || substr(md5(coalesce(content, '')), 1, 12) as source_name,
array_to_string(list_filter([{_strip('content')}, 'x', ''], lambda v: v is not null and v <> ''), '|') as filled, regexp_full_match(session_id::varchar, '[A-Za-z0-9_-]+') as safe, '[C] ' || role || coalesce(', page ' || session_id, '') as citation, '[C] Source: s' || chr(10) || substr(content, 1, 20) as excerpt from messages""",
        "mention_counts": f"""with {_CANON}, nn as (select distinct new_id as node_id, name from cv), held as (select distinct new_id as node_id, source, chunk_id from (select distinct label || '::' || name as node_id, source, chunk_id from m) h join cv using (node_id)),
tx as (select source, chunk_id, ' ' || regexp_replace(lower({_collapse('text')}), '([^\\p{{L}}\\p{{N}}_])', '\\1\\1', 'g') || ' ' as t from c)
select node_id, source, chunk_id, len(regexp_extract_all(t, '[^\\p{{L}}\\p{{N}}_]' || regexp_escape(regexp_replace(name, '([^\\p{{L}}\\p{{N}}_])', '\\1\\1', 'g')) || '[^\\p{{L}}\\p{{N}}_]'))::int as hits from held join nn using (node_id) join tx using (source, chunk_id)""",
        "user_sessions": "with s as (select distinct * from sessions) select id, title, updated_at from s where user_id = (select user_id from s group by 1 order by count(*) desc, user_id limit 1)",
        "session_messages": "with s as (select distinct id, user_id from sessions), m as (select distinct * from messages) select user_id, session_id, row_number() over (partition by session_id order by created_at nulls first, m.id) as turn, m.id from m join s on s.id = session_id",
        "deleted_session": "with f as (select id from sessions order by id limit 1) select 'sessions' as tab, count(*) as n from sessions where id not in (from f) or id is null union all select 'messages', count(*) from messages where session_id not in (from f) or session_id is null union all select 'files', count(*) from files where session_id not in (from f) or session_id is null",
        "faithfulness": _JUDGED + f", v as (select *, list_transform(sa, lambda s: {_support('te', 's')}) as v from k) select id, case when a = '' then 1.0 when len(sa) = 0 then null when e = '' then 0.0 else round(list_sum(v) / len(v)::double, 6) end::double as score from v",
        "coverage": _JUDGED + f", v as (select *, list_transform(sg, lambda s: {_support('ta', 's')}) as v from k) select id, case when g = '' then 1.0 when len(sg) = 0 then null else round(list_sum(v) / len(v)::double, 6) end::double as score from v",
        "context_recall": _JUDGED + f", v as (select *, list_transform(sg, lambda s: {_support('te', 's')}) as v from k) select id, case when len(v) > 0 then round(list_sum(v) / len(v)::double, 6) end as score from v",
        "context_relevance": _JUDGED + f", v as (select *, {_rouge('question')} as q from k) select id, case when len(q) = 0 then 0.0 else least(2, 3 * len(list_filter(q, lambda t: list_contains(te, t))) // len(q)) / 2.0 end::double as score from v",
        "answer_correctness": _JUDGED
        + f", v as (select *, len(list_filter(sa, lambda s: {_support('tg', 's')} = 1)) as tp, len(list_filter(sg, lambda s: {_support('ta', 's')} = 0)) as fn from k) select id, case when a = '' and g = '' then 1.0 when len(sa) = 0 or len(sg) = 0 then null when tp + fn = 0 then 0.0 else round(tp / (tp + fn)::double, 6) end::double as score from v",
        "local_candidates": f"""with {_CANON}, ce as (select least(a.new_id, b.new_id) as src, greatest(a.new_id, b.new_id) as dst, sum(weight)::bigint as weight from ec join cv a on a.node_id = src join cv b on b.node_id = dst where a.new_id <> b.new_id group by 1, 2), e2 as (select src, dst, weight from ce union all select dst, src, weight from ce),
held as (select distinct new_id as node, source || '_' || chunk_id as key from (select distinct label || '::' || name as node_id, source, chunk_id from m) h join cv using (node_id)), {_CHUNK_BM25},
qs as (select item_id, string_split(regexp_replace(question, '([.!?])[ \\t\\r\\n]+', '\\1' || chr(1), 'g'), chr(1)) as ss from eval_items), qx as (select item_id, unnest(ss) as sx from qs), qr as (select item_id, unnest(regexp_extract_all(sx, '{entities.NAME_RUN}')) as raw from qx),
sd as (select item_id as query_id, {_LABEL} || '::' || lower({_collapse('raw')}) as seed from qr where length({_collapse('raw')}) > 2 union select query_id, label || '::' || name from rk join m on m.source || '_' || m.chunk_id = doc_id where rank <= 5),
ne as (select * from (select src as seed, dst as neighbour, row_number() over (partition by src order by weight desc, dst) as r from e2 where src in (select seed from sd)) where r <= 5), hk as (select * from (select node, key, row_number() over (partition by node order by key) as r from held) where r <= 20),
ex as (select distinct query_id, key as doc_id from sd join ne using (seed) join hk on hk.node = neighbour)
select query_id, doc_id, round(score, 5) as score, 0 as origin, rank::int as place from rk where rank <= 20 union all select query_id, doc_id, 0.4, 1, 0 from ex where not exists (select 1 from rk where rk.query_id = ex.query_id and rk.doc_id = ex.doc_id and rank <= 20)""",
        "response_metadata": f"with {_CHUNKS}, {_CHUNK_BM25}, x as (select query_id, count(*) as num_hits, array_to_string(list_sort(list(distinct regexp_replace(doc_id, '_[^_]*$', ''))), '|') as sources from rk where rank <= 5 group by 1) select item_id as query_id, 'local' as mode, coalesce(num_hits, 0) as num_hits, 0::bigint as communities_used, coalesce(sources, '') as sources from eval_items left join x on query_id = item_id",
        "community_ids": f"with recursive {_NAMED} select community_id, node, member_rank, size from ids",
        "cover_scores": f"""with recursive {_NAMED}, tn as (select community_id, member_rank as k, lower(regexp_replace(node, '^.*::', '')) as name from ids where member_rank <= 20),
cd as (select distinct community_id, source, chunk_id from ids join held using (node)), ct as (select community_id, source, chunk_id, {_collapse('text')} as text from cd join c using (source, chunk_id) where text is not null),
sg as (select *, regexp_replace(lower(text), '{T.NOT_WORD}', '', 'g') as sig from ct), one as (select * from (select *, row_number() over (partition by community_id, sig order by source || '_' || chunk_id) as r from sg where sig <> '') where r = 1),
sc as (select o.community_id, source, chunk_id, any_value(length(text)) as n, sum(least((length(lower(text)) - length(replace(lower(text), name, ''))) / length(name), 4) * greatest(1.0, 4 - 0.2 * (k - 1))) as s, sum(case when contains(lower(text), name) then 1 else 0 end) as names from one o join tn using (community_id) group by o.community_id, source, chunk_id)
select community_id, source, chunk_id, round(s + 2 * names + least(n, 1500) / 1500.0::double, 4)::double as base, names::int as names from sc""",
        "format_context": f"""with p as (select distinct id, source, evidence, question_type from predictions), x as (select id, nullif(concat_ws(chr(10) || chr(10) || '---' || chr(10) || chr(10), case when question_type <> '' then '## Knowledge Graph Community Summaries' || chr(10) || chr(10) || '- ' || question_type end,
case when evidence is not null then '<source id="1" name="' || coalesce(source, 'unknown') || '">' || chr(10) || {_strip('evidence')} || chr(10) || '</source>' end), '') as context from p) select id as query_id, coalesce(context, 'No relevant content found.') as context from x""",
        "chat_recent_history": f"""with r as (select distinct session_id, id, lower({_strip('role')}) as role, content, created_at from messages), k as (select * from r where role in ('user', 'assistant') and {_strip('content')} <> ''),
l as (select *, row_number() over (partition by session_id order by created_at desc nulls last, id desc) as r from k) select session_id, row_number() over (partition by session_id order by created_at nulls first, id) as turn, id, role from l where r <= 12""",
        "session_titles": f"with r as (select session_id, arg_min(content, (created_at, id)) as c from messages where lower({_strip('role')}) = 'user' and {_strip('content')} <> '' group by 1) select session_id, case when length({_strip('c')}) > 40 then substr({_strip('c')}, 1, 40) || '...' else {_strip('c')} end as title from r",
        "orphan_sessions": "select distinct session_id from (select session_id from messages union all select session_id from files) where session_id is not null and session_id not in (select id from sessions where id is not null)",
        "sessions_per_user": "select user_id, count(*) as sessions, max(updated_at) as last_update from (select distinct * from sessions) group by 1",
        "stratified_sample": "select corpus_name, question_type, item_id from (select *, row_number() over (partition by corpus_name, question_type order by md5(item_id || '|42'), item_id) as r from eval_items) where r <= 5",
        "rouge1_recall": f"""with p as (select distinct id, question_type, generated_answer, gold_answer from predictions where error is null), t as (select id, {_rouge('generated_answer')} as a, {_rouge('gold_answer')} as g from p),
o as (select id, len(g) as n, coalesce(list_sum(list_transform(list_distinct(g), lambda w: least(len(list_filter(g, lambda x: x = w)), len(list_filter(a, lambda x: x = w))))), 0) as c from t) select id, case when n > 0 then round(c / n::double, 6) else 0.0 end as recall from o""",
        "eval_report": f"""with p as (select distinct id, question_type, generated_answer, gold_answer from predictions where error is null), t as (select id, question_type, {_rouge('generated_answer')} as a, {_rouge('gold_answer')} as g from p),
o as (select id, question_type, len(g) as n, coalesce(list_sum(list_transform(list_distinct(g), lambda w: least(len(list_filter(g, lambda x: x = w)), len(list_filter(a, lambda x: x = w))))), 0) as c from t)
select coalesce(question_type, 'Unknown') as question_type, 'rouge_score' as metric, round(avg(case when n > 0 then c / n::double else 0.0 end), 6) as mean, count(*) as n from o group by 1""",
        "metric_routing": "with p as (select distinct id, question_type from predictions where error is null), t as (select * from (values " + ", ".join(f"('{t}', '{m}')" for t, ms in evaluation.METRICS.items() for m in ms) + ") v(question_type, metric)) select metric, count(*) as n from p join t using (question_type) group by 1",
        "judged_scores": f"""with p as (select distinct id, question_type, generated_answer, gold_answer from predictions where error is null), a as (select id, {_rouge('generated_answer')} as a from p), v as (select id, len(a) as n, len(list_filter(a, lambda t: length(t) > 4)) as y from a),
s as (select id, n, case when n > 0 then y / n::double end as s, case when y + n % 3 > 0 then y / (y + n % 3)::double else 0 end as f from v) select id, round(s, 6) as share, round(f, 6) as factuality, case when n % 4 < 3 then (n % 4) / 2.0::double end as relevance, round(0.5 * s + 0.5 * f, 6) as correctness from s""",
        "replace_by_source": f"with {_CHUNKS} select source, chunk_id, case when source like 'file-%' then 0 else length(text) end::int as n from c",
        "ingest_stats": _BLOCKS
        + f""", x as (select id, {_strip("regexp_replace(regexp_replace(regexp_replace(regexp_replace(ps[i + 1], '" + T.HEADING + "', '\\1'), '" + T.HTML_TAG + "', ' ', 'g'), '" + T.NUMERIC_CITATION + "', ' ', 'g'), '" + T.HORIZONTAL + "', ' ', 'g')")} as text from bs)
select 'texts' as step, count(*) as n from (select distinct id, text from files) union all select 'raw_blocks', count(*) from bs union all select 'clean_blocks', count(*) from x where length(text) >= 3""",
        "event_windows": "select date_trunc('hour', ts) as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
    }
