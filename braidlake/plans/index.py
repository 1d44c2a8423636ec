"""Building an index from texts: chunks, vectors, graph, communities and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidlake.functions import models
from braidlake.functions import text as T
from braidlake.operators import chunking, community, entities
from braidlake.runtime import checkpointed
from braidlake.sources.store import Store, changed_sources, replaced_by_source

#: Default sizes of chunks.
CHUNK_WORDS, OVERLAP_WORDS = 500, 80


def chunks_of(texts: DataFrame, size: int = CHUNK_WORDS, overlap: int = OVERLAP_WORDS) -> DataFrame:
    """Cleaned chunks of (source, text)."""
    blocks = chunking.clean_blocks(chunking.parse_blocks(texts, "source", "text"))
    # Paragraphs of a text stay in its row's order; a text is bounded by its own size.
    joined = blocks.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_index", "text"))), lambda b: b["text"]), "\n\n").alias("text"))
    return chunking.chunk_with_offsets(joined, "source", "text", size, overlap)


def ingest_stats(texts: DataFrame, size: int = CHUNK_WORDS, overlap: int = OVERLAP_WORDS) -> DataFrame:
    """(step, n): texts, raw_blocks, clean_blocks and new_chunks of (source, text) rows."""
    raw = chunking.parse_blocks(texts, "source", "text")
    count = lambda name, df: df.agg(F.lit(name).alias("step"), F.count("*").alias("n"))
    return count("texts", texts).unionByName(count("raw_blocks", raw)).unionByName(count("clean_blocks", chunking.clean_blocks(raw))).unionByName(count("new_chunks", chunks_of(texts, size, overlap)))


def build_graph(chunks: DataFrame, extractor=None, canonicaliser=entities.canonical_names) -> dict[str, DataFrame]:
    """mentions, nodes, edges and entity_chunks of a chunk table."""
    # Texts are read once; all tables come from the mentions.
    found = checkpointed(entities.mentions(chunks, extractor))
    nodes, held, per_chunk = entities.node_stats(found), entities.entity_chunks(found), entities.edge_chunks(found)
    new_nodes, new_edges, new_held = entities.canonicalize(nodes, held, per_chunk, canonicaliser(nodes))
    return {"mentions": found, "nodes": new_nodes, "edges": new_edges, "entity_chunks": new_held}


def community_tables(graph: dict[str, DataFrame], chunks: DataFrame, model=None) -> dict[str, DataFrame]:
    """community_members and community_summaries of a graph."""
    counts = graph["nodes"].select(F.col("node_id").alias("node"), "mention_count")
    members = checkpointed(community.communities(graph["edges"], counts))
    texts = chunks.select("source", "chunk_id", "text")
    homes = members.join(graph["entity_chunks"].withColumnRenamed("node_id", "node"), "node")
    # Communities of chunks stay narrow rows; each text is joined once where it is needed.
    candidates = checkpointed(homes.select(F.col("community_id").cast("bigint").alias("community_id"), "source", "chunk_id").distinct())
    matches = checkpointed(community.entity_matches(members, candidates, texts))
    ranked = checkpointed(community.rank_entities(members.join(counts, "node").select("community_id", "node", "mention_count"), graph["edges"], matches))
    chosen = checkpointed(community.representative_chunks(candidates, ranked, chunks=texts))
    return {"community_members": members, "community_summaries": community.summaries(members, ranked, chosen, texts, model)}


class Index:
    """An index in a folder; `ingest` replaces texts by source, skips unchanged ones and rebuilds the graph."""

    def __init__(self, spark: SparkSession, folder: str, embedder: models.Embedder | None = None, extractor=None, generator=None) -> None:
        self.spark, self.store = spark, Store(spark, folder)
        self.embedder, self.extractor, self.generator = embedder, extractor, generator

    def ingest_segment(self, session_id, title: str, content: str) -> dict[str, int]:
        """Adds one text of a session under a name made of its title and content; a blank text or a session id that may
        not name a folder is an error."""
        if not (content or "").strip():
            raise ValueError("the text must not be blank")
        rows = self.spark.createDataFrame([(str(session_id), title, content)], "session_id string, title string, text string")
        if not rows.select(T.safe_folder("session_id").alias("ok")).first()["ok"]:
            raise ValueError("a session id has letters, digits, _ and - only")
        return self.ingest(rows.select(T.source_name("title", "text").alias("source"), "text"))

    def ingest(self, texts: DataFrame, size: int = CHUNK_WORDS, overlap: int = OVERLAP_WORDS, rebuild: bool = True) -> dict[str, int]:
        """Adds (source, text) rows; gives counts of raw and clean blocks, chunks, nodes, edges and communities.

        Without `rebuild` the graph and its communities stay as they are until `rebuild` is called, so that a stream of
        small batches need not build them each time.
        """
        if self.store.has("sources"):
            texts = changed_sources(texts, self.store.load("sources")).drop("content_hash")
        hashes = texts.select("source", F.md5(F.encode("text", "utf-8")).alias("content_hash"))
        counts = {r["step"]: r["n"] for r in ingest_stats(texts, size, overlap).collect()}
        new = chunks_of(texts, size, overlap)
        self.store.replace_sources("chunks", new)
        vectors = models.embed_column(self.store.load("chunks").join(hashes.select("source"), "source", "left_semi"), "text", "embedding", self.embedder)
        self.store.replace_sources("chunk_vectors", vectors.select("source", F.md5("source").alias("source_id"), "chunk_id", "token_count", "embedding"))
        known = replaced_by_source(self.store.load("sources"), hashes) if self.store.has("sources") else hashes
        self.store.save("sources_new", known)  # the old table is still read while the new one is written
        self.store.save("sources", self.store.load("sources_new"))
        return counts | (self.rebuild() if rebuild else {})

    def rebuild(self) -> dict[str, int]:
        chunks = self.store.load("chunks")
        for name, df in build_graph(chunks, self.extractor).items():
            self.store.save(name, df)
        graph = {n: self.store.load(n) for n in ("nodes", "edges", "entity_chunks")}
        tables = community_tables(graph, chunks, self.generator)
        self.store.save("community_members", tables["community_members"].withColumn("community_id", F.col("community_id").cast("int")))
        self.store.save("community_summaries", tables["community_summaries"].withColumn("community_id", F.col("community_id").cast("bigint")))
        members = self.store.load("community_members")
        return {"chunks": chunks.count(), "nodes": graph["nodes"].count(), "edges": graph["edges"].count(), "communities": members.select("community_id").distinct().count()}
