"""Session helpers shared by every operator: reading tables, spreading Python work, cutting lineage."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """Gives a scan at least one partition per core before Python work.

    A large table already has more splits than cores and passes through unchanged; only a table
    of few splits is shuffled, so the cost is bounded by cores x split size.
    The partition count of plain scans, filters and projections is known without running a job; anything with a
    shuffle in its plan is left to adaptive execution, which sizes partitions by what they hold.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    plan = scan._jdf.queryExecution().optimizedPlan().toString()
    if any(step in plan for step in ("Join ", "Aggregate ", "Window ", "Sort ", "Distinct", "Repartition", "WithCTE")):
        return scan
    if scan.rdd.getNumPartitions() >= cores:
        return scan
    return scan.repartition(cores * 2, *keys)


def tasks(spark: SparkSession) -> int:
    """Number of shuffle tasks the session wants."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def python_tasks(spark: SparkSession) -> int:
    """Number of partitions for a shuffle before heavy Python work; given as a number, so that small bytes of costly
    work aren't coalesced into a few tasks."""
    return max(tasks(spark), 2 * spark.sparkContext.defaultParallelism)


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialises `df` in the shared folder of spark.checkpoint.dir and cuts its lineage.

    The files survive the loss of executors. Only a session in one JVM (local tests) may name no folder and gets a
    temporary one; on a cluster that would be a folder of one machine, so it is an error there.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="braidlake-checkpoint-"))
    return df.checkpoint(eager=True)


def words(col):
    """Lower-case runs of letters and digits of a string column, as an array; null gives an empty array."""
    return F.regexp_extract_all(F.lower(F.coalesce(col, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), 0)


def cpu_threads() -> None:
    """Keeps numeric libraries to one thread in a Python worker, which already has one core."""
    for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "RAYON_NUM_THREADS"):
        os.environ.setdefault(name, "1")


def numbered(df: DataFrame, order: list[str], into: str) -> DataFrame:
    """Adds consecutive numbers from 0 in a total order, without bringing all rows into one task.

    Rows are range-partitioned and sorted; only the size of each partition reaches the driver.
    """
    spark = df.sparkSession
    n = max(tasks(spark), spark.sparkContext.defaultParallelism)
    marked = checkpointed(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_place", 33)
    sizes = marked.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).orderBy("_part").collect()
    starts, total = [], 0
    for r in sizes:
        starts.append((r["_part"], total))
        total += r["_n"]
    offsets = spark.createDataFrame(starts, "_part bigint, _start bigint")
    inside = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return marked.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(into, F.col("_start") + inside).drop("_part", "_place", "_start")


def ranked(df: DataFrame, groups: list[str], order: list[str], into: str) -> DataFrame:
    """Adds the rank from 1 of every row within its group, in a total order of the columns `order`.

    A window would sort each group in one task; here rows are numbered over range partitions, and a group's first
    number is taken off, so a group may hold any share of the rows. Group columns must not be null.
    """
    numbers = numbered(df, [*groups, *order], "_number")
    starts = numbers.groupBy(*groups).agg(F.min("_number").alias("_first"))
    return numbers.join(starts, groups).withColumn(into, F.col("_number") - F.col("_first") + 1).drop("_number", "_first")


def may_hold(rows: DataFrame, key: str, bits: int = 18):
    """A test of bigint columns: whether a value may be one of `rows[key]`; it never misses one.

    The values are put into 2**bits bits by hash, so what reaches the driver and the plan is bounded whatever the rows.
    """
    place = lambda x: F.xxhash64(x).bitwiseAND(F.lit((1 << bits) - 1))
    inside = lambda x: place(x).bitwiseAND(F.lit(31)).cast("int")
    words = [0] * (1 << (bits - 5))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), inside(F.col(key)))
    for r in rows.groupBy(F.shiftright(place(F.col(key)), 5).alias("at")).agg(F.bit_or(one).alias("on")).collect():
        words[r["at"]] = r["on"]
    table = F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")
    return lambda x: F.call_function("getbit", F.get(table, F.shiftright(place(x), 5).cast("int")), inside(x)) == 1
