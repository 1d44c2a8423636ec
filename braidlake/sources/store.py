"""Tables of an index in one folder: write, read, replace by source."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidlake.runtime import checkpointed

# Schemas of the tables of an index.
SCHEMAS = {
    "chunks": "source string, chunk_id int, text string, char_start int, char_end int, token_count int",
    "chunk_vectors": "source string, source_id string, chunk_id int, token_count int, embedding array<float>",
    "mentions": "source string, chunk_id int, sent_id int, pos int, name string, label string",
    "nodes": "node_id string, name string, label string, mention_count bigint, chunk_count bigint",
    "edges": "src string, dst string, weight bigint, chunk_count bigint",
    "entity_chunks": "node_id string, source string, chunk_id int",
    "community_members": "community_id int, node string, member_rank int, size bigint",
    "community_summaries": "community_id bigint, title string, summary string, summary_status string",
    "v2_chunks": "id string, source string, page int, text string",
    "v2_extractions": "chunk_id string, entities array<struct<name string, type string, description string>>, relationships array<struct<source string, target string, type string, description string>>, error string",
    "v2_entities": "id string, name string, type string, description string, chunk_count bigint",
    "v2_entity_chunks": "id string, chunk_id string, pos int",
    "v2_relationships": "source string, target string, type string, weight bigint, description string, chunk_count bigint",
    "v2_communities": "id string, level int, parent_id string, node string",
    "v2_reports": "community_id string, title string, summary string, findings array<string>, chunk_ids array<string>, text string",
}
#: Folders that the rows of a table with sources are spread over.
BUCKETS = 64


class Store:
    """A folder with a parquet table per name."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def save(self, name: str, df: DataFrame, partition: str | None = None) -> None:
        writer = df.write.mode("overwrite")
        (writer.partitionBy(partition) if partition else writer).parquet(self.path(name))

    def load(self, name: str) -> DataFrame:
        reader = self.spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else self.spark.read
        return reader.parquet(self.path(name)).drop("bucket")

    def has(self, name: str) -> bool:
        try:
            return bool(self.spark.read.parquet(self.path(name)).columns)
        except AnalysisException:
            return False

    def replace_sources(self, name: str, df: DataFrame) -> None:
        """Replaces the rows of every source in `df`.

        Sources are hashed into a fixed number of folders, so many small sources make no small files; only the folders
        of the sources in `df` are written again.
        """
        new = checkpointed(df.withColumn("bucket", F.pmod(F.xxhash64("source"), F.lit(BUCKETS)).cast("int")))
        if self.has(name):
            touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most BUCKETS rows
            old = self.spark.read.parquet(self.path(name)).where(F.col("bucket").isin(touched)).withColumn("bucket", F.col("bucket").cast("int"))
            # What is kept is written out before its folder is replaced.
            new = checkpointed(replaced_by_source(old.select(*new.columns), new))
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path(name))


def replaced_by_source(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old rows of the sources that `new` lacks, and all new rows."""
    return old.join(new.select("source").distinct(), "source", "left_anti").unionByName(new)


def unseen(new: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that a resumed job still has to do."""
    return new.join(done.select(*keys).distinct(), keys, "left_anti")


def changed_sources(texts: DataFrame, known: DataFrame) -> DataFrame:
    """Texts whose (source, content hash) isn't known yet."""
    return texts.withColumn("content_hash", F.md5(F.encode("text", "utf-8"))).join(known.select("source", "content_hash"), ["source", "content_hash"], "left_anti")
