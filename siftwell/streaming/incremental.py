"""The audit as a stream: pages land as files, findings, counters and change marks follow; checkpoints take the place of resume files."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from siftwell.operators.page_rules import RULES, body_blocks
from siftwell.sources.extract import extract_pages

ON_BLOCKS = ("corruption", "shattered", "duplicate_paragraph")
ON_PAGES = ("meta", "heading_structure", "blank", "placeholder", "empty_slot", "lorem_page", "misspelling", "scope", "dead_cta", "social_misrouted", "duplicate_link", "empty_row", "markup")
FINDING = "url string, check string, class string, fingerprint string, severity string, issue string, location string, snippet string, matched string"
KEPT_HOURS = 48
BUCKETS = 4096  # of URLs whose pages are remembered


def read_page_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def findings_stream(spark: SparkSession, found_path: str) -> DataFrame:
    """What ``audit_batches`` has written, as a stream: a batch folder is written once and never again."""
    return spark.readStream.schema(FINDING).option("recursiveFileLookup", True).parquet(found_path)


def page_findings(pages: DataFrame) -> DataFrame:
    """Findings of all rules that need nothing but the page (columns of ``extract_pages``)."""
    blocks = body_blocks(pages)
    found = [RULES[name]["run"](pages) for name in ON_PAGES] + [RULES[name]["run"](blocks) for name in ON_BLOCKS]
    return reduce(DataFrame.unionByName, found)


def _folder(path: str, number: int) -> str:
    return f"{path.rstrip('/')}/batch={number}"


def _stands(spark: SparkSession, folder: str) -> bool:
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return done.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(done)


def _write_once(rows: DataFrame, path: str, number: int) -> None:
    """The folder of a batch, unless it stands already: a batch that runs again changes nothing."""
    folder = _folder(path, number)
    if not _stands(rows.sparkSession, folder):
        rows.write.mode("overwrite").parquet(folder)


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def audit_batches(pages: DataFrame, out_path: str, errors_path: str, checkpoint: str):
    """All page rules over each micro-batch of raw pages (url, html), as rules number repeats on a page. Each batch has a folder that is
    written once; pages that break the parser are listed beside the findings.

    The parsed pages of a batch are stored in files beside the checkpoint until both are written: each rule reads its own columns of them, while
    a cache that has left memory is read whole by every rule.
    """
    parsed_path = f"{checkpoint.rstrip('/')}-parsed"

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if _stands(spark, _folder(errors_path, number)) and _stands(spark, _folder(out_path, number)):
            return
        made = extract_pages(batch)
        _write_once(made, parsed_path, number)
        parsed = spark.read.schema(made.schema).parquet(_folder(parsed_path, number))
        _write_once(page_findings(parsed), out_path, number)
        _write_once(parsed.where("error is not null").select("url", "error"), errors_path, number)
        _remove(spark, _folder(parsed_path, number))

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counter_batches(found: DataFrame, out_path: str, checkpoint: str):
    """Findings by check and severity, in update mode: a batch writes the new totals of the keys that it has moved, under its number.

    The state is one number a check and severity. ``read_counters`` takes the newest total of each key.
    """
    counts = found.groupBy("check", "severity").agg(F.count("*").alias("n"))
    write = lambda batch, number: _write_once(batch, out_path, number)
    return counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_counters(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("check string, severity string, n bigint, batch bigint").parquet(path)
    return rows.groupBy("check", "severity").agg(F.max_by("n", "batch").alias("n"))


def event_windows(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Views and clicks by hour, for append mode: a window comes out, and its state goes, when the watermark has passed its end; later rows are left out."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    sums = timed.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return sums.select(F.col("window.start").alias("start"), "event_type", "n", "value")


def annotate_batches(found: DataFrame, history_path: str, out_path: str, checkpoint: str):
    """new or persisting against the history table, for each micro-batch; a batch that runs again overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        prior = batch.sparkSession.read.parquet(history_path).select("fingerprint", F.col("first_seen").alias("seen"))
        joined = batch.join(prior, "fingerprint", "left").withColumn("status", F.when(F.col("seen").isNotNull(), "persisting").otherwise("new"))
        _write_once(joined, out_path, number)

    return found.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class PageMemory(StatefulProcessor):
    """new, changed or unchanged for every arrival that is not older than what is known of its URL; a URL is forgotten when the watermark passes its newest arrival.

    The state and the timer are those of a bucket of URLs, as each call to the state store costs far more than a URL. The timer is never later than the first
    URL to forget, and an arrival does not move it to a later time: a timer that comes too early is set again.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("bucket", "timer bigint, newest map<string,struct<content_hash:string,at:bigint>>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        timer, newest = self._read()
        first = timer
        for r in sorted(rows, key=lambda r: (r.at, r.content_hash is None, r.content_hash)):
            known = newest.get(r.url)
            if known is None or known[1] <= r.at:
                yield Row(url=r.url, content_hash=r.content_hash, at=r.at, change="new" if known is None else "unchanged" if known[0] == r.content_hash else "changed")
                newest[r.url] = (r.content_hash, r.at)
                first = self._due(r.at) if first is None else min(first, self._due(r.at))
        if first != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(first)
        self.bucket.update((first, newest))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        newest = {url: known for url, known in self._read()[1].items() if self._due(known[1]) >= timerValues.getCurrentWatermarkInMs()}
        if newest:
            first = min(self._due(at) for _, at in newest.values())
            self.handle.registerTimer(first)
            self.bucket.update((first, newest))
        else:
            self.bucket.clear()
        return iter(())

    def _read(self) -> tuple[int | None, dict[str, tuple]]:
        timer, newest = self.bucket.get() or (None, {})
        return timer, {url: tuple(known) for url, known in newest.items()}

    @staticmethod
    def _due(at: int) -> int:
        return at // 1000 + 1

    def close(self) -> None:
        pass


def page_changes(pages: DataFrame, late: str = f"{KEPT_HOURS} hours", buckets: int = BUCKETS) -> DataFrame:
    """``pages``: url, content_hash, fetched_at. The last arrival of a URL wins; pages older than ``late`` are dropped, and a URL not seen for so long is new again.

    The state is one hash and one time a URL of the last ``late``, in ``buckets`` by the hash of the URL: a batch reads and writes the buckets that it meets, so give
    some for every hundred URLs; a checkpoint keeps to its number. Needs the RocksDB state store.
    """
    timed = pages.where("url is not null and fetched_at is not null").withWatermark("fetched_at", late)
    rows = timed.select(F.pmod(F.xxhash64("url"), F.lit(buckets)).alias("bucket"), "url", "content_hash", "fetched_at", F.unix_micros("fetched_at").alias("at"))
    found = rows.groupBy("bucket").transformWithState(PageMemory(), "url string, content_hash string, at bigint, change string", "Append", "EventTime")
    return found.select("url", "content_hash", F.timestamp_micros("at").alias("fetched_at"), "change")


def latest_in_batches(pages: DataFrame, out_path: str, checkpoint: str, late: str = f"{KEPT_HOURS} hours"):
    """Last line of each URL of a micro-batch that is at most ``late`` older than the batch's newest, without state; ``read_latest`` takes the newest over batches."""

    def write(batch: DataFrame, number: int) -> None:
        fresh = batch.join(batch.agg((F.max("fetched_at") - F.expr(f"interval {late}")).alias("oldest")), F.col("fetched_at") >= F.col("oldest")).drop("oldest")  # one row
        newest = fresh.groupBy("url").agg(F.max(F.struct("fetched_at", "content_hash")).alias("r"))
        _write_once(newest.select("url", "r.content_hash", "r.fetched_at"), out_path, number)

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """url, content_hash, fetched_at of each URL's newest line."""
    rows = spark.read.schema("url string, content_hash string, fetched_at timestamp").parquet(path)
    return rows.groupBy("url").agg(F.max(F.struct("fetched_at", "content_hash")).alias("r")).select("url", "r.content_hash", "r.fetched_at")
