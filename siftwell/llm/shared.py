"""Helpers that several operators share: folders, text batches, distributed ranks."""

from __future__ import annotations

import math
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, the folder that all executors share.

    Where the session names none, a session on one machine (tests) gets a temporary one; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="siftwell-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.stored_path = path
    return back


def discard(*frames: DataFrame) -> None:
    """Remove stored tables that no plan needs any more."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def numbered_columns(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns named by their place, so that added names clash with none, and the new name of each old one."""
    names = {c: f"_c{i}" for i, c in enumerate(df.columns)}
    return df.select(*[F.col(f"`{c.replace('`', '``')}`").alias(n) for c, n in names.items()]), names


def named_again(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns of ``numbered_columns`` under their old names, others left out."""
    return df.select(*[F.col(n).alias(c) for c, n in names.items()])


def group_key(col: Column) -> Column:
    """A non-null string that orders like ``col`` by code point, null last."""
    return F.coalesce(F.concat(F.lit("0"), col), F.lit("1"))


def slots(n_rows: int, rows_per_slot: int | None = None) -> int:
    """How many slots keep about ``rows_per_slot`` rows each; by default, as many slots as a slot has rows.

    Then both levels of ``prefix_in_group`` grow with the root of the table: 100,000 each for 10^10 rows.
    """
    return max(1, -(-n_rows // (rows_per_slot or max(250, math.isqrt(n_rows)))))


def hash_slot(h: Column, n: int) -> Column:
    """0..n-1, never falling as the 64-bit hash ``h`` rises."""
    unit = (h.cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.least(F.floor(unit * n), F.lit(n - 1)).cast("int")


def prefix_in_group(df: DataFrame, group: str, slot: str, order: list[Column], amount: str, out: str, total: str) -> DataFrame:
    """Add ``out``, the sum of ``amount`` over earlier rows of the group, and ``total``, that of the group.

    Two levels: sums per (group, slot) give each slot its offset, a window inside the
    slot gives the rest. A group with a third of all rows is thus spread over all slots.
    ``slot`` must never fall along ``order``.
    """
    by_slot = W.partitionBy(group).orderBy(slot)
    sums = (
        df.groupBy(group, slot)
        .agg(F.sum(amount).alias("_slot_sum"))
        .withColumn("_offset", F.sum("_slot_sum").over(by_slot) - F.col("_slot_sum"))
        .withColumn(total, F.sum("_slot_sum").over(W.partitionBy(group)))
        .drop("_slot_sum")
    )
    inside = W.partitionBy(group, slot).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        df.join(sums, [group, slot])
        .withColumn(out, F.col("_offset") + F.sum(amount).over(inside) - F.col(amount))
        .drop("_offset")
    )


def text_slices(batch, column: int, max_bytes: int = 1 << 20):
    """Slices of an Arrow batch with about ``max_bytes`` of text each; a longer text is alone in its slice."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column).cast(pa.large_binary())), 0)
    ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
    give_back()


def give_back() -> None:
    """Return freed memory to the system: a Python worker lives on for other stages, and its allocators would keep it."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        pass
