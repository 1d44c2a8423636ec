"""Items that appear together (problem 2).

Method: basket collapsing. Rows become baskets (sorted distinct item arrays), identical baskets collapse into
one row with a weight, pairs are enumerated once per distinct basket and their weights summed; lift and
conviction come from the pair count, the two item counts and the number of baskets.

A basket longer than `long_basket` is never gathered into one row. It collapses with identical ones too, told by its size
and 128 bits of order-free hashes of its items; its items are hashed into blocks and each pair of blocks becomes a task
of its own, so one basket may hold any share of the rows. Both ways give the same pairs with the same weight.

Defined results: rows with a null item or a null basket column belong to no basket; repeated rows count once;
a basket of one item counts for the item and the number of baskets and gives no pair; an empty table gives no
rows; no other column is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _pairs_of_blocks(rows: DataFrame, basket: list[str], block_items: int) -> DataFrame:
    """(a, b, weight) of every pair in long baskets, by pairs of hashed blocks; `rows` has _item, _size and weight."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col("_size") / F.lit(block_items))).cast("int")
    placed = (
        rows.withColumn("_blocks", blocks)
        .withColumn("_mine", F.pmod(F.xxhash64("_item"), F.col("_blocks")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .withColumn("_low", F.least("_mine", "_other"))
        .withColumn("_high", F.greatest("_mine", "_other"))
    )
    tiles = placed.groupBy(*basket, "weight", "_low", "_high").agg(
        F.collect_list(F.when(F.col("_mine") == F.col("_low"), F.col("_item"))).alias("_left"),
        F.collect_list(F.when(F.col("_mine") == F.col("_high"), F.col("_item"))).alias("_right"),
    )
    one = tiles.select("_low", "_high", "weight", F.explode("_left").alias("_x"), "_right")
    two = one.select("_low", "_high", "weight", "_x", F.explode("_right").alias("_y"))
    kept = two.where((F.col("_low") != F.col("_high")) | (F.col("_x") < F.col("_y")))
    return kept.select(F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b"), "weight")


def cooccurrence(
    df: DataFrame, item: str, basket: list[str], min_count: int = 1, min_lift: float = 0.0, long_basket: int = 4000, block_items: int = 1000
) -> DataFrame:
    """(id_a, id_b, n_ab, n_a, n_b, n, lift, conviction) of pairs id_a < id_b that stand in at least `min_count`
    baskets together and reach `min_lift`. conviction is that of a -> b, null where a never stands without b.
    """
    keys = [f"_k{i}" for i in range(len(basket))]
    rows = df.select(F.col(item).alias("_item"), *[F.col(c).alias(k) for c, k in zip(basket, keys)]).dropna()
    crowded = rows.groupBy(*keys).agg(F.count("*").alias("_rows")).where(F.col("_rows") > long_basket).select(*keys)
    some_crowded = not crowded.isEmpty()
    short = rows.join(crowded, keys, "left_anti") if some_crowded else rows
    collapsed = short.groupBy(*keys).agg(F.array_sort(F.collect_set("_item")).alias("_items")).groupBy("_items").agg(F.count("*").alias("weight"))
    head = collapsed.where(F.size("_items") > 1).select("weight", "_items", F.posexplode("_items").alias("_at", "a"))
    pairs = head.select("a", F.explode(F.slice("_items", F.col("_at") + 2, F.size("_items"))).alias("b"), "weight")
    singles = collapsed.select(F.explode("_items").alias("_item"), "weight")
    baskets = collapsed.agg(F.sum("weight").alias("n"))
    if some_crowded:
        long = rows.join(crowded, keys, "left_semi").distinct()
        signs = long.groupBy(*keys).agg(
            F.count("*").alias("_size"), F.bit_xor(F.xxhash64("_item", F.lit(1))).alias("_x"), F.bit_xor(F.xxhash64("_item", F.lit(2))).alias("_y")
        )
        heads = signs.groupBy("_size", "_x", "_y").agg(F.min(F.struct(*keys)).alias("_head"), F.count("*").alias("weight"))
        chosen = long.join(heads.select("_head.*", "_size", "weight"), keys)
        pairs = pairs.unionByName(_pairs_of_blocks(chosen, keys, block_items))
        singles = singles.unionByName(chosen.select("_item", "weight"))
        baskets = baskets.unionByName(heads.agg(F.sum("weight").alias("n"))).agg(F.sum("n").alias("n"))
    counts = singles.groupBy("_item").agg(F.sum("weight").alias("_n"))
    together = pairs.groupBy("a", "b").agg(F.sum("weight").alias("n_ab")).where(F.col("n_ab") >= min_count)
    scored = (
        together.join(counts.select(F.col("_item").alias("a"), F.col("_n").alias("n_a")), "a")
        .join(counts.select(F.col("_item").alias("b"), F.col("_n").alias("n_b")), "b")
        .withColumn("n", baskets.scalar())
        .withColumn("lift", F.col("n_ab") * F.col("n") / (F.col("n_a").cast("double") * F.col("n_b")))
    )
    alone = 1 - F.col("n_ab") / F.col("n_a")
    return scored.where(F.col("n_ab") * F.col("n") >= F.lit(min_lift) * F.col("n_a") * F.col("n_b")).select(
        F.col("a").alias("id_a"),
        F.col("b").alias("id_b"),
        "n_ab",
        "n_a",
        "n_b",
        "n",
        "lift",
        F.when(alone > 0, (1 - F.col("n_b") / F.col("n")) / alone).alias("conviction"),
    )
