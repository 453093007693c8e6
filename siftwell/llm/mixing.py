"""Mixing sources to target weights along a time-varying curriculum.

Targets. Sources in code-point order (null last) weigh 1, 2, 3, repeating, and share the
words of all documents. A target stops at ``cap`` times the source's size and the excess is
shared again by weight: water filling, solved in closed form over sources sorted by cap / weight.

Copies. A source takes its documents in seeded-hash order, again and again, until its target
is met; the document at the edge is taken when its middle lies inside. So taken words differ
from the target by half a document at most and no document is taken more than ``cap`` times.

Curriculum. Every source has a weight schedule over training time 0..1, piecewise linear
between ``knots``. Its integral, scaled to the target, is the cumulative token demand; the
inverse of that, at the token offset of a copy, is the copy's training position. Rows are
range-sorted by position.

Plans are made of ids, hashes and sizes; texts move once to their place in the plan and once in the range sort.

Null or empty texts have size 0 and are taken 0 times in words; they keep the copies of their
place in the order. A source without words has target 0. Repeated rows count as rows of their own; rows of equal id and size
stand in the order of a hash of all their columns. Very long texts are counted whole and are never cut.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siftwell.llm.shared import WORD, group_key, hash_slot, named_again, numbered_columns, prefix_in_group, slots, stored

SOURCES = 10_000  # sources that are ranked in one task
KNOTS = (0.0, 0.5, 1.0)
SCHEDULES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))  # for weights 1, 2, 3: early, even, late


@dataclass(frozen=True)
class Schedule:
    """A piecewise-linear density over 0..1 and its inverse integral."""

    knots: Sequence[float]
    levels: Sequence[float]

    def integral(self) -> list[float]:
        out = [0.0]
        for i in range(1, len(self.knots)):
            out.append(out[-1] + (self.knots[i] - self.knots[i - 1]) * (self.levels[i] + self.levels[i - 1]) / 2)
        return out

    def inverse(self, share: Column) -> Column:
        """The time at which ``share`` (0..1) of the whole integral is reached."""
        total = self.integral()
        want = share * total[-1]
        time = F.lit(self.knots[-1])
        for i in reversed(range(len(self.knots) - 1)):
            level, width = self.levels[i], self.knots[i + 1] - self.knots[i]
            slope = (self.levels[i + 1] - level) / width
            part = F.greatest(want - total[i], F.lit(0.0))
            # the root of level * x + slope * x^2 / 2 = part, in the form that is stable for small slopes
            root = F.try_divide(2 * part, level + F.sqrt(F.greatest(F.lit(level * level) + 2 * slope * part, F.lit(0.0))))
            time = F.when(want <= total[i + 1], F.least(self.knots[i] + F.coalesce(root, F.lit(0.0)), F.lit(self.knots[i + 1]))).otherwise(time)
        return time


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, cap: int = 3, cycle: int = 3) -> DataFrame:
    """``sizes``: _group, source_size. Adds weight and target; the sum of targets is the sum of sizes.

    Sources are ranked in range parts of about ``SOURCES`` each, and the water level is sought over sums by cap / weight, in
    slots of its logarithm: no task sees all sources, of which there may be as many as hosts.
    """
    n_parts = max(1, -(-sizes.count() // SOURCES))
    ranged = stored(sizes.repartitionByRange(n_parts, "_group").withColumn("_slot", F.spark_partition_id()), "sources")
    ranged = ranged.withColumns({"_all": F.lit(0), "_one": F.lit(1).cast("long")})
    weighed = prefix_in_group(ranged, "_all", "_slot", [F.col("_group")], "_one", "_rank", "_n").drop("_slot", "_one", "_n")
    weighed = weighed.withColumn("weight", (F.col("_rank") % cycle + 1).cast("int")).drop("_rank")
    ratio = F.lit(float(cap)) * F.col("source_size") / F.col("weight")
    sums = weighed.groupBy("_all", ratio.alias("_ratio")).agg(F.sum("source_size").alias("_size"), F.sum("weight").alias("_weight"))
    sums = sums.withColumn("_slot", F.when(F.col("_ratio") > 0, F.floor(F.log2("_ratio") * 32)).otherwise(F.lit(-(10**6))))
    sums = prefix_in_group(sums, "_all", "_slot", [F.col("_ratio")], "_size", "_size_before", "_size_all")
    sums = prefix_in_group(sums, "_all", "_slot", [F.col("_ratio")], "_weight", "_weight_before", "_weight_all")
    # the level if all sources of a smaller cap / weight stop at their cap; the first that fits is the level
    level = (F.col("_size_all") - cap * F.col("_size_before")) / (F.col("_weight_all") - F.col("_weight_before"))
    level = sums.withColumn("_level", level).where("_level <= _ratio").groupBy("_all").agg(F.min_by("_level", "_ratio").alias("_level"))
    placed = weighed.join(F.broadcast(level), "_all", "left")  # one row
    return placed.withColumn("target", F.least(F.lit(float(cap)) * F.col("source_size"), F.coalesce(F.col("_level") * F.col("weight"), F.lit(0.0)))).drop("_level", "_all")


def _placed(rows: DataFrame, seed: int, cap: int, cycle: int) -> DataFrame:
    """``rows``: _id, _source, _row (a hash), size and others. Adds _before (words of the source's earlier rows), source_size, weight and target."""
    rows = rows.withColumns({"_group": group_key(F.col("_source")), "_hash": F.xxhash64(F.lit(seed), "_id", "size")})
    rows = rows.withColumn("_slot", hash_slot(F.col("_hash"), slots(rows.count())))
    offset = prefix_in_group(rows, "_group", "_slot", [F.col("_hash"), F.col("_id"), F.col("size"), F.col("_row")], "size", "_before", "source_size")
    targets = source_targets(rows.groupBy("_group").agg(F.sum("size").alias("source_size")), cap, cycle).drop("source_size")
    return offset.join(targets, "_group").drop("_group", "_hash", "_slot")


def _taken(planned: DataFrame, cap: int, knots: Sequence[float], schedules: Sequence[Sequence[float]]) -> DataFrame:
    """Adds copies, taken and positions (one for each copy) to rows of _before, size, source_size, weight and target."""
    passes = F.when(F.col("source_size") > 0, F.least(F.lit(cap), F.floor(F.col("target") / F.col("source_size")))).otherwise(0)
    planned = planned.withColumn("_passes", passes.cast("long"))
    edge = F.col("_before") + F.col("size") / 2 < F.col("target") - F.col("_passes") * F.col("source_size")
    planned = planned.withColumn("copies", (F.col("_passes") + F.when(edge, 1).otherwise(0)).cast("long"))

    def place(turn: Column) -> Column:
        share = F.least(F.lit(1.0), (turn * F.col("source_size") + F.col("_before")) / F.col("target"))
        time = F.lit(None).cast("double")
        for i, levels in enumerate(schedules):
            time = F.when(F.col("weight") == i + 1, Schedule(tuple(knots), tuple(levels)).inverse(share)).otherwise(time)
        return time

    turns = F.when(F.col("copies") > 0, F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).otherwise(F.array().cast("array<bigint>"))
    return planned.withColumns({"taken": F.col("copies") * F.col("size"), "positions": F.transform(turns, place)})


def mix_plan(
    df: DataFrame, seed: int = 42, cap: int = 3, knots: Sequence[float] = KNOTS, schedules: Sequence[Sequence[float]] = SCHEDULES,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """Per document: id, source, size, source_size, weight, target, copies, taken, positions (one for each copy)."""
    rows = df.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), F.xxhash64(text_col).alias("_row"), word_count(F.col(text_col)).alias("size"))
    planned = _taken(_placed(rows, seed, cap, len(schedules)), cap, knots, schedules)
    return planned.select(F.col("_id").alias(id_col), F.col("_source").alias(source_col), "size", "source_size", "weight", "target", "copies", "taken", "positions")


def range_sorted(planned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows in order of their first training position; those not taken come last."""
    first = F.coalesce(F.try_element_at("positions", F.lit(1)), F.lit(2.0))
    return planned.withColumn("first_position", first).repartitionByRange("first_position", id_col).sortWithinPartitions("first_position", id_col)


def mix(
    df: DataFrame, seed: int = 42, cap: int = 3, knots: Sequence[float] = KNOTS, schedules: Sequence[Sequence[float]] = SCHEDULES,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """The mixed corpus: the columns of ``df``, one row for each copy taken, range-sorted by training position.

    Rows are found again by two hashes of all their columns; equal rows stand next to each other in the plan, and the
    n-th of them begins n sizes after the first.
    """
    numbered, names = numbered_columns(df)
    one, text, source = names[id_col], names[text_col], names[source_col]
    keys = {"_row": F.xxhash64(*numbered.columns), "_row2": F.xxhash64(F.lit(seed + 1), *numbered.columns)}
    rows = numbered.select(F.col(one).alias("_id"), F.col(source).alias("_source"), word_count(F.col(text)).alias("size"), *[c.alias(k) for k, c in keys.items()])
    plan = _placed(rows, seed, cap, len(schedules)).groupBy("_row", "_row2").agg(*[F.min(c).alias(c) for c in ("_before", "size", "source_size", "weight", "target")])
    nth = F.row_number().over(W.partitionBy("_row", "_row2").orderBy("_row")) - 1
    placed = numbered.withColumns(keys).withColumn("_nth", nth).join(plan, ["_row", "_row2"]).withColumn("_before", F.col("_before") + F.col("_nth") * F.col("size"))
    copies = _taken(placed, cap, knots, schedules).select(*numbered.columns, F.explode("positions").alias("_position"))
    return named_again(copies.repartitionByRange("_position", one).sortWithinPartitions("_position", one), names)
