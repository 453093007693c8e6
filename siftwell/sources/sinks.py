"""Sinks. Runs are published whole or not at all; slices are replaced, keys upserted; repeats change nothing.

Tables that are replaced in parts are versioned stores (``versions``): read them with ``versions.read``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.operators.history import upsert_triage
from siftwell.operators.traffic import aggregate_traffic
from siftwell.sources import versions

CSV_COLUMNS = ("url", "title", "check", "class", "severity", "status", "issue", "location", "snippet", "suggestion", "page_count", "n_sources", "fingerprint")


def write_findings_jsonl(found: DataFrame, path: str) -> None:
    found.write.mode("overwrite").json(path)


def findings_csv(found: DataFrame, titles: DataFrame) -> DataFrame:
    """Thirteen columns: sources as a count, the title joined by url; columns that are missing are null."""
    joined = found.join(titles.select("url", "title"), "url", "left")
    if "sources" in found.columns:
        joined = joined.withColumn("n_sources", F.coalesce(F.size("sources"), F.lit(0)))
    have = set(joined.columns)
    return joined.select(*[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in CSV_COLUMNS])


def write_findings_csv(found: DataFrame, titles: DataFrame, path: str) -> None:
    findings_csv(found, titles).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_summary(run: DataFrame, rollup: DataFrame, path: str) -> None:
    """Run fields and the rollup as one JSON line."""
    counts = rollup.agg(F.collect_list(F.struct(*rollup.columns)).alias("rollup"))  # a row for each check and severity
    run.crossJoin(F.broadcast(counts)).select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def publish_run(found: DataFrame, audited: DataFrame, path: str, brand: str, run_id: str, summary: DataFrame | None = None) -> bool:
    """Replaces the findings of brand and run, and their summary, in one version; False and nothing written when no page was audited.

    A run without findings leaves no rows of an older one.
    """
    if audited.isEmpty():
        return False
    key = (("brand", brand), ("run_id", run_id))
    versions.commit(found.sparkSession, path, lambda _: {("findings", key): found} | ({("summary", key): summary} if summary is not None else {}))
    return True


def new_runs(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows of (brand, report_dir) that are not there yet, each once."""
    return incoming.dropDuplicates(["brand", "report_dir"]).join(existing.select("brand", "report_dir").distinct(), ["brand", "report_dir"], "left_anti")


def import_run(incoming: DataFrame, path: str) -> None:
    spark = incoming.sparkSession
    try:
        fresh = new_runs(incoming, spark.read.schema(incoming.schema).parquet(path))
    except Exception as e:  # the first import
        if "PATH_NOT_FOUND" not in str(e):
            raise
        fresh = incoming.dropDuplicates(["brand", "report_dir"])
    fresh.write.mode("append").parquet(path)


def merged_projection(old: DataFrame, new: DataFrame) -> DataFrame:
    """Newest projection of each page: old ones without a new one, then the new."""
    return old.join(new.select("url").distinct(), "url", "left_anti").unionByName(new)


def store_projection(new: DataFrame, path: str) -> None:
    """The stored projections with the new ones in place of theirs; ``new``: one row a URL."""
    _store_merged(new, path, "projection", merged_projection)


def store_triage(decisions: DataFrame, path: str) -> None:
    """The stored decisions with the new ones."""
    _store_merged(decisions, path, "triage", upsert_triage)


def _store_merged(new: DataFrame, path: str, table: str, merged) -> None:
    spark = new.sparkSession

    def change(base: versions.Version) -> versions.Changes:
        old = versions.read(spark, path, table, base)
        return {(table, ()): merged(new.limit(0) if old is None else old, new)}

    versions.commit(spark, path, change)


def write_history(found: DataFrame, components: DataFrame, path: str, partial_sample: bool) -> bool:
    """Snapshot of the run's fingerprints, one row each and first seen when any finding of it was, and of rule components, both in one version; a cut sample never replaces a baseline."""
    if partial_sample:
        return False
    once = found.groupBy("fingerprint").agg(F.min(F.struct("url", "check")).alias("of"), F.min("first_seen").alias("first_seen")).select("fingerprint", "of.url", "of.check", "first_seen")
    versions.commit(found.sparkSession, path, lambda _: {("findings", ()): once, ("components", ()): components})
    return True


def store_traffic(rows: DataFrame, path: str, brand: str, period: str, source: str, imports_path: str | None = None) -> None:
    """Replace one slice of (brand, period, source); ``rows`` as exported. With ``imports_path``, record rows read and pages stored."""
    pages = aggregate_traffic(rows) if "pos" in rows.columns else rows
    key = (("brand", brand), ("period", period), ("source", source))
    versions.commit(rows.sparkSession, path, lambda _: {("traffic", key): pages})
    if imports_path:
        counts = rows.agg(F.count("*").alias("rows_read"), F.count_distinct("url_key").alias("pages_stored"))
        versions.commit(rows.sparkSession, imports_path, lambda _: {("imports", key): counts})
