"""Sharding by proportional stratified interleaving.

Inside each source the rows are shuffled by a seeded hash and ranked; rank r of n has the
fractional rank (r + 0.5) / n. Sorting all rows by it deals the sources out evenly, so any
run of consecutive rows holds every source in proportion. Equal cuts of that order are the shards.

Both ranks are two-level prefix counts over hash (or rank) slots, so a source with a third
of all rows is no larger a task than any other, and no task sees the whole order.

Null sources form one group of their own; null texts have size 1. Repeated rows are ranked
one after the other. Equal (id, size, text) rows are interchangeable. Very long texts only give their size and checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.shared import group_key, hash_slot, prefix_in_group, slots


def interleaved_shards(
    df: DataFrame, n_shards: int = 16, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """id, source, size (bytes of the text + 1), text_crc32, fractional_rank, position, shard, slot; counts of shards differ by one at most."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    ).withColumns({"_group": group_key(F.col("source")), "_hash": F.xxhash64(F.lit(seed), "id", "text_crc32", "size"), "_one": F.lit(1).cast("long")})
    n_rows = df.count()
    n_slots = slots(n_rows)
    order = [F.col("_hash"), F.col("id"), F.col("size"), F.col("text_crc32")]
    rows = rows.withColumn("_slot", hash_slot(F.col("_hash"), n_slots))
    ranked = prefix_in_group(rows, "_group", "_slot", order, "_one", "_rank", "_rows").drop("_slot")
    ranked = ranked.withColumn("fractional_rank", (F.col("_rank") + 0.5) / F.col("_rows"))
    ranked = ranked.withColumns({"_all": F.lit(0), "_slot": F.least(F.floor(F.col("fractional_rank") * n_slots), F.lit(n_slots - 1)).cast("int")})
    placed = prefix_in_group(ranked, "_all", "_slot", [F.col("fractional_rank"), F.col("_group"), *order], "_one", "position", "_n")
    shard = F.expr(f"cast(position * {n_shards} div _n as int)")
    slot = F.expr(f"position - (shard * _n + {n_shards - 1}) div {n_shards}")
    return placed.withColumn("shard", shard).withColumn("slot", slot).select(
        F.col("id").alias(id_col), "source", "size", "text_crc32", "fractional_rank", "position", "shard", "slot"
    )


def write_shards(df: DataFrame, assigned: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write whole rows of ``df`` as one folder per shard, in slot order; ids must be unique."""
    places = assigned.select(F.col(id_col).alias("_id"), "shard", "slot")
    joined = df.join(places, df[id_col].eqNullSafe(F.col("_id"))).drop("_id")
    joined.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
