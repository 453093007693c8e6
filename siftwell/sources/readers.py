"""Readers of landed files. Formats are read by Spark, with explicit schemas; broken lines are dropped, never fatal."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

FINDING = "fingerprint string, url string, check string, class string, severity string, issue string, snippet string, status string, first_seen string, last_seen string, page_count long, sources array<string>"
RUN = "run_id string, brand string, run_at string, pages_audited long, status string"
PROJECTION = "url string, version string, fetched_at string, title string, h1_text string, content_hash string, link_urls array<string>"
# fixed values: names that exports use for the same column
TRAFFIC_HEADERS = {
    "url": ("top pages", "page", "url", "address", "landing page"), "clicks": ("clicks", "url clicks"), "impressions": ("impressions",), "position": ("position", "average position", "avg. pos"),
}


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block, line, value: lines in the order of the file, whatever splits it is read in."""
    meta = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    return spark.read.text(path).select(*meta, F.monotonically_increasing_id().alias("line"), "value")


def read_findings_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One finding a line; blank and broken lines are skipped, the first row of a fingerprint stays."""
    lines = text_lines(spark, path).where(F.trim("value") != "").select("file", "block", "line", F.from_json("value", FINDING).alias("f"))
    good = lines.where("f.fingerprint is not null")
    first = good.withColumn("rn", F.row_number().over(W.partitionBy("f.fingerprint").orderBy("file", "block", "line"))).where("rn = 1")
    return first.select("f.*")


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Run summaries ordered by their own time; where it cannot be read, by that of the file."""
    rows = spark.read.schema(RUN).json(path).select("*", F.col("_metadata.file_modification_time").alias("_mtime"))
    return rows.withColumn("run_at_ts", F.coalesce(F.try_to_timestamp("run_at"), "_mtime")).drop("_mtime").orderBy("run_at_ts")


def number(col):
    """``1,234``, ``2.86%``, ``-`` and ``~`` as exports write them."""
    return F.expr(f"try_cast(regexp_replace({col}, '[,%\\\\s]', '') as double)")


def read_traffic_csv(spark: SparkSession, path: str) -> DataFrame:
    """A search export with any of the known headers; ``pos`` follows the file. Every value is ``unknown``; another header shape raises."""
    raw = spark.read.option("header", True).csv(path)
    lower = {c.strip().lower(): c for c in raw.columns}
    names = {}
    for field, aliases in TRAFFIC_HEADERS.items():
        names[field] = next((lower[a] for a in aliases if a in lower), None)
    if names["url"] is None or names["clicks"] is None:
        raise ValueError(f"no traffic export: {raw.columns}")
    value = lambda f: number(f"`{names[f]}`") if names[f] else F.lit(None).cast("double")
    return raw.select(
        F.col(f"`{names['url']}`").alias("url"), F.monotonically_increasing_id().alias("pos"), value("clicks").cast("long").alias("clicks"),
        value("impressions").cast("long").alias("impressions"), value("position").alias("position"), F.lit("unknown").alias("value_state"),
    )


def sitemap_urls(docs: DataFrame, roots: list[str], depth: int = 3) -> tuple[DataFrame, DataFrame]:
    """``docs``: url, xml (null: could not be fetched). Page URLs below the root sitemaps, each once, and the sitemaps that failed.

    A recursive query follows indexes to their children, ``depth`` levels at most; a way down never comes to a sitemap twice, so
    indexes that name each other end. What is deeper is left out. Only names of sitemaps recur; the documents are read once more, for their pages.
    """
    spark, name = docs.sparkSession, f"_sitemap_index_{uuid.uuid4().hex}"
    loc = F.explode(F.regexp_extract_all("xml", F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1)))
    is_index = F.contains("xml", F.lit("<sitemapindex"))
    spark.createDataFrame([(r,) for r in roots], "url string").createOrReplaceTempView(f"{name}_roots")
    docs.where(is_index).select(F.col("url").alias("above"), loc.alias("url")).distinct().createOrReplaceTempView(name)
    reached = spark.sql(
        f"""WITH RECURSIVE way(url, level, seen) AS (
          SELECT url, 1, array(url) FROM {name}_roots
          UNION ALL SELECT below.url, way.level + 1, array_append(way.seen, below.url) FROM way JOIN {name} AS below ON below.above = way.url
          WHERE way.level < {int(depth)} AND NOT array_contains(way.seen, below.url))
        SELECT DISTINCT url FROM way"""
    )
    read = reached.join(docs, "url", "left")
    return read.where(~is_index).select(loc.alias("url")).distinct(), read.where("xml is null").select("url").distinct()


def cms_listing_urls(docs: DataFrame) -> DataFrame:
    """``docs``: page_no, json. Links of paged listings, first occurrence."""
    rows = docs.select("page_no", F.posexplode(F.from_json("json", "array<struct<link:string>>")).alias("pos", "x"))
    return rows.where("x.link is not null").groupBy(F.col("x.link").alias("url")).agg(F.min(F.struct("page_no", "pos")).alias("first")).select("url", "first.page_no", "first.pos")


def url_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("url")).where("url <> '' and not url like '#%'")


def page_cache_latest(spark: SparkSession, path: str, version: str, now, max_hours: int = 48) -> DataFrame:
    """Last cached projection of each URL, of this rule version and not known to be too old; torn lines are ignored."""
    lines = text_lines(spark, path).select("file", "block", "line", F.from_json("value", PROJECTION).alias("p"))
    at = F.try_to_timestamp("p.fetched_at")
    fresh = lines.where((F.col("p.url").isNotNull()) & (F.col("p.version") == version) & (at.isNull() | (at >= now - F.expr(f"interval {max_hours} hours"))))
    return fresh.groupBy(F.col("p.url").alias("_u")).agg(F.max_by("p", F.struct("file", "block", "line")).alias("p")).select("p.*")


def exclude_urls(df: DataFrame, parts: list[str]) -> DataFrame:
    out = df
    for p in parts:
        out = out.where(~F.col("url").contains(p))
    return out


def is_ok():
    return F.col("error").isNull() & (F.col("status") == 200) & (F.coalesce("html", F.lit("")) != "")
