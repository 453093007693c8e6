"""Colour contrast and markup violations: ratios, nearest passing colour, one row for each pair or shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.operators.collapse import SAMPLE, first_of


def channels(colour: Column) -> Column:
    """Red, green and blue of ``#rgb`` or ``#rrggbb``; null otherwise."""
    bare = F.lower(F.regexp_replace(F.trim(colour), "^#", ""))
    full = F.when(F.length(bare) == 3, F.regexp_replace(bare, "(.)", "$1$1")).otherwise(bare)
    return F.when(full.rlike("^[0-9a-f]{6}$"), F.array(*[F.conv(F.substring(full, i, 2), 16, 10).cast("int") for i in (1, 3, 5)]))


def luminance(rgb: Column) -> Column:
    """WCAG relative luminance."""

    def part(v: Column) -> Column:
        s = v / 255
        return F.when(s <= 0.03928, s / 12.92).otherwise(F.pow((s + 0.055) / 1.055, F.lit(2.4)))

    return 0.2126 * part(F.get(rgb, F.lit(0))) + 0.7152 * part(F.get(rgb, F.lit(1))) + 0.0722 * part(F.get(rgb, F.lit(2)))


def contrast_ratio(a: Column, b: Column) -> Column:
    """Ratio of two ``channels`` arrays."""
    la, lb = luminance(a), luminance(b)
    return (F.greatest(la, lb) + 0.05) / (F.least(la, lb) + 0.05)


def nearest_passing(pairs: DataFrame) -> DataFrame:
    """``pairs``: fg, bg, required. Adds ``suggested``: the least darkening or lightening, in 100 steps, that passes; ties darken; null if none does."""
    f, b = channels(F.col("fg")), channels(F.col("bg"))
    steps = F.sequence(F.lit(1), F.lit(100))
    ready = pairs.withColumns({"_f": f, "_b": b})

    def shade(step: Column, lighter: bool) -> Column:
        t = step / 100
        return F.transform("_f", lambda c: F.round(c + (255 - c) * t if lighter else c * (1 - t)).cast("int"))

    def scan(lighter: bool) -> Column:
        passing = F.filter(steps, lambda s: contrast_ratio(shade(s, lighter), F.col("_b")) >= F.col("required"))
        return F.array_min(passing)

    ready = ready.withColumns({"_dark": scan(False), "_light": scan(True)})
    dark = F.col("_dark").isNotNull() & (F.col("_light").isNull() | (F.col("_dark") <= F.col("_light")))
    rgb = F.when(contrast_ratio(F.col("_f"), F.col("_b")) >= F.col("required"), F.col("_f")).when(dark, shade(F.col("_dark"), False)).when(F.col("_light").isNotNull(), shade(F.col("_light"), True))
    hexed = F.concat(F.lit("#"), F.array_join(F.transform(rgb, lambda c: F.lpad(F.lower(F.hex(c.cast("long"))), 2, "0")), ""))
    return ready.withColumn("suggested", hexed).drop("_f", "_b", "_dark", "_light")


def collapse_contrast(measured: DataFrame) -> DataFrame:
    """``measured``: url, fg, bg, ratio, required, selector. One row per (fg, bg, required): elements, pages, worst ratio, example, suggestion."""
    sums = measured.groupBy("fg", "bg", "required").agg(
        F.count("*").alias("elements"), F.count_distinct("url").alias("pages"), F.min("ratio").alias("ratio"), F.min_by("selector", F.struct("url", "selector")).alias("example")
    )
    return nearest_passing(sums)


def contrast_coverage(assessed: DataFrame, least: float = 0.6) -> DataFrame:
    """``assessed``: url, reason (null: measured; else why it was withheld). Per page under ``least``: share and the main reason."""
    sums = assessed.groupBy("url").agg(F.count("*").alias("n"), F.count_if(F.col("reason").isNull()).alias("measured"))
    why = assessed.where("reason is not null").groupBy("url", "reason").agg(F.count("*").alias("k")).groupBy("url").agg(F.max_by("reason", F.struct("k", "reason")).alias("reason"))
    return sums.where(F.col("measured") < F.col("n") * least).join(why, "url").select("url", F.round(F.col("measured") / F.col("n"), 6).alias("coverage"), "reason")


def href_shape(href: Column) -> Column:
    """Path segments of digits as N, at most 60 characters."""
    return F.substring(F.regexp_replace(href, r"(?<=/)\d+(?=/|$)", "N"), 1, 60)


def collapse_markup(violations: DataFrame) -> DataFrame:
    """``violations``: url, rule, href. One row per (rule, shape of the address): pages and a sample of them."""
    shaped = violations.withColumn("shape", href_shape(F.coalesce("href", F.lit(""))))
    sums = shaped.groupBy("rule", "shape").agg(F.count("*").alias("elements"), F.count_distinct("url").alias("pages"))
    return sums.join(first_of(shaped, ["rule", "shape"], "url", SAMPLE, "samples"), ["rule", "shape"])
