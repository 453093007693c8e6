"""Readers, sinks and streams over files of a temporary folder."""

import json

import pytest
from pyspark.sql import functions as F

from siftwell.sources import readers, sinks, versions
from siftwell.streaming import incremental


def test_findings_lines(spark, tmp_path):
    good = {"fingerprint": "f", "url": "u", "severity": "error"}
    (tmp_path / "f.jsonl").write_text("\n".join([json.dumps(good), "", "{torn", json.dumps({**good, "url": "second"}), json.dumps({**good, "fingerprint": "g"})]))
    got = readers.read_findings_jsonl(spark, f"file://{tmp_path}/f.jsonl")
    assert sorted((r.fingerprint, r.url) for r in got.collect()) == [("f", "u"), ("g", "u")]


def test_traffic_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text('Top pages,Clicks,Impressions,CTR,Position\nhttps://h.com/a,"1,234",~,2.86%,3.5\nhttps://h.com/b,-,10,0%,1\n')
    got = readers.read_traffic_csv(spark, f"file://{tmp_path}/t.csv").orderBy("pos").collect()
    assert [(r.clicks, r.impressions, r.position, r.value_state) for r in got] == [(1234, None, 3.5, "unknown"), (None, 10, 1.0, "unknown")]
    (tmp_path / "x.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        readers.read_traffic_csv(spark, f"file://{tmp_path}/x.csv")


def test_runs_sitemaps_listings_lists(spark, tmp_path):
    (tmp_path / "runs.json").write_text('{"run_id":"b","run_at":"2024-02-01T00:00:00Z"}\n{"run_id":"a","run_at":"2024-01-01T00:00:00Z"}\n{"run_id":"c","run_at":"junk"}\n')
    assert [r.run_id for r in readers.read_runs(spark, f"file://{tmp_path}/runs.json").collect()][:2] == ["a", "b"]
    docs = spark.createDataFrame([("root", "<sitemapindex><loc>one</loc><loc> two </loc></sitemapindex>"), ("one", "<urlset><loc>http://h/a</loc><loc>http://h/b</loc><loc>http://h/a</loc></urlset>")], "url string, xml string")
    pages, failed = readers.sitemap_urls(docs, ["root"])
    assert sorted(r.url for r in pages.collect()) == ["http://h/a", "http://h/b"] and [r.url for r in failed.collect()] == ["two"]
    listing = spark.createDataFrame([(1, '[{"link":"x"},{"link":"y"}]'), (2, '[{"link":"x"}]'), (3, "junk")], "page_no int, json string")
    assert sorted((r.url, r.page_no) for r in readers.cms_listing_urls(listing).collect()) == [("x", 1), ("y", 1)]
    (tmp_path / "list.txt").write_text("# note\n\n http://h/a \n")
    assert [r.url for r in readers.url_list(spark, f"file://{tmp_path}/list.txt").collect()] == ["http://h/a"]


def test_sitemaps_of_any_depth(spark):
    docs = [(f"m{i}", f"<sitemapindex><loc>m{i + 1}</loc><loc>lost{i}</loc></sitemapindex>") for i in range(4)] + [("m4", "<urlset><loc>http://h/deep</loc></urlset>")]
    df = spark.createDataFrame(docs, "url string, xml string")
    for depth in (1, 2, 3, 4, 5):
        found, failed = readers.sitemap_urls(df, ["m0"], depth)
        assert [r.url for r in found.collect()] == (["http://h/deep"] if depth == 5 else [])
        assert sorted(r.url for r in failed.collect()) == [f"lost{i}" for i in range(depth - 1)]
        shallow, _ = readers.sitemap_urls(df, ["m4"], depth)
        assert [r.url for r in shallow.collect()] == ["http://h/deep"]


def test_sitemaps_that_name_each_other_end(spark):
    index = lambda *x: "<sitemapindex>" + "".join(f"<loc>{u}</loc>" for u in x) + "</sitemapindex>"
    docs = spark.createDataFrame([("a", index("b", "c", "a")), ("b", index("a", "c", "gone")), ("c", "<urlset><loc>http://h/x</loc></urlset>"), ("d", None), ("e", "<urlset><loc>http://h/never</loc></urlset>")], "url string, xml string")
    found, failed = readers.sitemap_urls(docs, ["a", "d", "nowhere"], 9)
    assert [r.url for r in found.collect()] == ["http://h/x"] and sorted(r.url for r in failed.collect()) == ["d", "gone", "nowhere"]


def test_a_run_without_findings_leaves_no_old_rows(spark, tmp_path):
    at = f"file://{tmp_path}/p"
    found = spark.createDataFrame([("f", "u")], "fingerprint string, url string")
    for run in ("r1", "r2"):
        assert sinks.publish_run(found, found, at, "b", run)
    assert sinks.publish_run(found.limit(0), found, at, "b", "r1")
    assert [r.run_id for r in versions.read(spark, at, "findings").collect()] == ["r2"]
    rows = spark.createDataFrame([("b", "h", "open", "", 1)], "brand string, fingerprint_hash string, state string, note string, updated_at int")
    sinks.store_triage(rows, f"{at}-t")
    sinks.store_triage(rows.selectExpr("brand", "fingerprint_hash", "'fixed' state", "note", "2 updated_at"), f"{at}-t")
    assert [r.state for r in versions.read(spark, f"{at}-t", "triage").collect()] == ["fixed"]


def test_a_writer_that_fails_before_its_manifest_changes_nothing(spark, tmp_path, monkeypatch):
    at = f"file://{tmp_path}/store"
    old = spark.createDataFrame([("u", "old"), ("v", "old")], "url string, title string")
    new = spark.createDataFrame([("u", "new"), ("w", "new")], "url string, title string")
    sinks.store_projection(old, at)

    def fails(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(versions, "_put_manifest", fails)
        with pytest.raises(OSError):
            sinks.store_projection(new, at)
        with pytest.raises(OSError):
            sinks.write_history(old.selectExpr("url fingerprint", "url", "url check", "title first_seen"), old, at, False)
    rows = lambda t: sorted(map(tuple, versions.read(spark, at, t).collect()))
    assert rows("projection") == [("u", "old"), ("v", "old")] and versions.read(spark, at, "findings") is None and versions.read(spark, at, "components") is None
    sinks.store_projection(new, at)
    assert rows("projection") == [("u", "new"), ("v", "old"), ("w", "new")]
    assert versions.vacuum(spark, at, keep=1, hours=1000) == 0 and versions.vacuum(spark, at, keep=1, hours=0) == 4
    assert rows("projection") == [("u", "new"), ("v", "old"), ("w", "new")] and versions.current(spark, at).number == 2


def test_findings_and_summary_appear_together_and_writers_do_not_lose_each_other(spark, tmp_path):
    at = f"file://{tmp_path}/store"
    found, total = spark.createDataFrame([("f", "u")], "fingerprint string, url string"), spark.createDataFrame([(1,)], "total int")
    assert sinks.publish_run(found, found, at, "b/1", "r", total)
    calls = []

    def change(base):
        calls.append(base.number)
        if len(calls) == 1:  # another writer comes first
            sinks.publish_run(found, found, at, "c", "r", total)
        return {("findings", (("brand", "d"), ("run_id", "r"))): found.withColumn("more", F.lit(1))}

    assert versions.commit(spark, at, change).number == 3 and calls == [1, 2]
    assert sorted((r.brand, r.more) for r in versions.read(spark, at, "findings").collect()) == [("b/1", None), ("c", None), ("d", 1)]
    assert [r.total for r in versions.read(spark, at, "summary", brand="b/1").collect()] == [1]
    versions.commit(spark, at, lambda base: {(p.table, p.key): None for p in base.parts if ("brand", "c") in p.key})
    assert sorted(r.brand for r in versions.read(spark, at, "summary").collect()) == ["b/1"]
    with pytest.raises(RuntimeError):
        versions.commit(spark, at, lambda base: sinks.publish_run(found, found, at, "e", "r") and {}, attempts=2)


def test_the_stream_of_all_rules_equals_one_batch(spark, tmp_path):
    from siftwell.plans import catalog_kernel
    from siftwell.sources import extract

    at = f"file://{tmp_path}"
    pages = catalog_kernel.made_pages(spark, "/root/testdata/sf0.001").select("url", "html")
    pages.repartition(5).write.parquet(f"{at}/in")
    stream = spark.readStream.schema("url string, html string").option("maxFilesPerTrigger", 2).parquet(f"{at}/in")
    for _ in range(2):
        incremental.audit_batches(stream, f"{at}/out", f"{at}/errors", f"{at}/ck").awaitTermination()
    got = sorted(r.fingerprint for r in spark.read.parquet(f"{at}/out").collect())
    assert got == sorted(r.fingerprint for r in incremental.page_findings(extract.extract_pages(pages)).collect()) and len({f.split(":")[0] for f in got}) >= 8
    assert spark.read.schema("url string, error string").parquet(f"{at}/errors").count() == 0


def test_page_cache(spark, tmp_path):
    line = lambda url, v, at, t: json.dumps({"url": url, "version": v, "fetched_at": at, "title": t})
    (tmp_path / "c.jsonl").write_text("\n".join([line("u", "1", "2024-01-02T00:00:00Z", "old"), line("u", "1", "2024-01-02T01:00:00Z", "new"), line("v", "0", "2024-01-02T00:00:00Z", "x"), line("w", "1", "2023-12-01T00:00:00Z", "x"), '{"url":"t']))
    got = readers.page_cache_latest(spark, f"file://{tmp_path}/c.jsonl", "1", F.lit("2024-01-03").cast("timestamp"))
    assert [(r.url, r.title) for r in got.collect()] == [("u", "new")]


def test_sinks(spark, tmp_path):
    found = spark.createDataFrame([("f", "u", "c", "x", "error", ["a", "b"], "then")], "fingerprint string, url string, check string, class string, severity string, sources array<string>, first_seen string")
    titles = spark.createDataFrame([("u", "Title")], "url string, title string")
    at = f"file://{tmp_path}"
    sinks.write_findings_jsonl(found, f"{at}/j")
    assert spark.read.json(f"{at}/j").first().sources == ["a", "b"]
    sinks.write_findings_csv(found, titles, f"{at}/c")
    row = spark.read.option("header", True).csv(f"{at}/c").first()
    assert (row.title, row.n_sources) == ("Title", "2") and len(row) == 13
    assert not sinks.publish_run(found, titles.limit(0), f"{at}/p", "b", "r1")
    for _ in range(2):
        assert sinks.publish_run(found, titles, f"{at}/p", "b", "r1") and sinks.publish_run(found, titles, f"{at}/p", "b", "r2")
    assert versions.read(spark, f"{at}/p", "findings").count() == 2
    runs = spark.createDataFrame([("b", "d1"), ("b", "d2")], "brand string, report_dir string")
    sinks.import_run(runs.limit(1), f"{at}/r")
    sinks.import_run(runs, f"{at}/r")
    sinks.import_run(runs, f"{at}/r")
    assert spark.read.parquet(f"{at}/r").count() == 2
    components = spark.createDataFrame([("x", "1")], "component string, value string")
    assert not sinks.write_history(found, components, f"{at}/h", True) and sinks.write_history(found, components, f"{at}/h", False)
    t = spark.createDataFrame([("k", 1)], "url_key string, clicks int")
    for _ in range(2):
        sinks.store_traffic(t, f"{at}/t", "b", "p1", "csv")
        sinks.store_traffic(t, f"{at}/t", "b", "p2", "csv")
    assert versions.read(spark, f"{at}/t", "traffic").count() == 2
    sinks.write_summary(runs.limit(1), spark.createDataFrame([("total", 3)], "level string, n int"), f"{at}/s")
    assert json.loads(spark.read.text(f"{at}/s").first()[0])["rollup"] == [{"level": "total", "n": 3}]
    old = spark.createDataFrame([("u", 1), ("v", 1)], "url string, x int")
    assert sorted((r.url, r.x) for r in sinks.merged_projection(old, spark.createDataFrame([("u", 2)], "url string, x int")).collect()) == [("u", 2), ("v", 1)]


def test_streams(spark, tmp_path):
    at = f"file://{tmp_path}"
    pages = spark.createDataFrame([("https://h.com/Bad_Slug", "<p>short</p>"), ("https://h.com/ok", None)], "url string, html string")
    pages.write.parquet(f"{at}/in")
    incremental.audit_batches(incremental.read_page_stream(spark, f"{at}/in", "url string, html string"), f"{at}/found", f"{at}/errors", f"{at}/ck0").awaitTermination()
    found = incremental.findings_stream(spark, f"{at}/found")
    history = spark.createDataFrame([("blank:thin:https://h.com/ok", "then")], "fingerprint string, first_seen string")
    history.write.parquet(f"{at}/history")
    incremental.annotate_batches(found, f"{at}/history", f"{at}/out", f"{at}/ck").awaitTermination()
    out = spark.read.parquet(f"{at}/out")
    got = {(r.url.rsplit("/", 1)[1], r["class"]): r.status for r in out.collect()}
    assert got[("ok", "thin")] == "persisting" and got[("Bad_Slug", "malformed_slug")] == "new" and ("ok", "missing_title") in got
    incremental.annotate_batches(found, f"{at}/history", f"{at}/out", f"{at}/ck").awaitTermination()
    assert spark.read.parquet(f"{at}/out").count() == out.count()
    incremental.counter_batches(found, f"{at}/counters", f"{at}/ck1").awaitTermination()
    assert incremental.read_counters(spark, f"{at}/counters").agg(F.sum("n")).first()[0] == out.count()


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    at = f"file://{tmp_path}"
    rows = lambda n: spark.createDataFrame([("c", "s", n)], "check string, severity string, n long")
    for number, n in ((0, 1), (1, 5), (0, 9)):
        incremental._write_once(rows(n), f"{at}/c", number)
    assert incremental.read_counters(spark, f"{at}/c").first().n == 5 and spark.read.parquet(f"{at}/c").count() == 2


def test_last_line_of_a_url_wins(spark, tmp_path):
    at = f"file://{tmp_path}"
    rows = spark.sql("select * from values ('u', 'a', timestamp'2024-01-01'), ('u', 'b', timestamp'2024-01-02'), ('v', 'c', timestamp'2024-01-01') as t(url, content_hash, fetched_at)")
    rows.write.parquet(f"{at}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{at}/in")
    incremental.latest_in_batches(stream, f"{at}/out", f"{at}/ck").awaitTermination()
    assert sorted((r.url, r.content_hash) for r in incremental.read_latest(spark, f"{at}/out").collect()) == [("u", "b"), ("v", "c")]


def test_page_changes_keep_one_hash_a_url_over_batches(spark, tmp_path):
    at = f"file://{tmp_path}"
    schema = "url string, content_hash string, fetched_at timestamp"
    say = lambda *rows: spark.sql("select url, content_hash, cast(at as timestamp) as fetched_at from values " + ", ".join(map(str, rows)) + " as t(url, content_hash, at)").coalesce(1).write.mode("append").parquet(f"{at}/in")

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def run():
        stream = spark.readStream.schema(schema).parquet(f"{at}/in")
        query = incremental.page_changes(stream).writeStream.format("parquet").option("checkpointLocation", f"{at}/ck").trigger(availableNow=True).start(f"{at}/out")
        query.awaitTermination()
        return sorted((r.url, r.content_hash, r.change) for r in spark.read.schema(f"{schema}, change string").parquet(f"{at}/out").collect())

    say(("u", "a", "2024-01-01"), ("v", "c", "2024-01-02"))
    first = [("u", "a", "new"), ("v", "c", "new")]
    assert run() == first
    say(("u", "b", "2024-01-03"), ("v", "c", "2024-01-03"))
    assert run() == sorted(first + [("u", "b", "changed"), ("v", "c", "unchanged")])
    say(("u", "z", "2024-01-02"), ("w", "d", "2024-01-03"), ("x", "e", "2023-12-30"))  # u: older than what is known, x: older than 48 hours
    assert run() == sorted(first + [("u", "b", "changed"), ("v", "c", "unchanged"), ("w", "d", "new")])
    say(("y", "f", "2024-01-09"))
    run()
    say(("v", "c", "2024-01-09"))  # forgotten meanwhile
    assert ("v", "c", "new") in [r for r in run() if r not in first] or run().count(("v", "c", "new")) == 2
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def _changes_by_hand(batches, kept_ms):
    """What ``page_changes`` must say of batches of (url, hash, hour); the watermark of a batch comes from the rows before it and, for timers, from itself."""
    known, out, newest, floor = {}, [], None, 0
    for rows in batches:
        for url, h, hour in sorted(rows, key=lambda r: (r[2], r[1])):
            at = hour * 3_600_000
            if at > floor and (url not in known or known[url][1] <= at):
                out.append((url, h, hour, "new" if url not in known else "unchanged" if known[url][0] == h else "changed"))
                known[url] = (h, at)
        newest = max([at * 3_600_000 for _, _, at in rows] + ([newest] if newest is not None else []))
        floor = max(floor, newest - kept_ms)
        known = {u: k for u, k in known.items() if k[1] + 1 >= floor}
    return sorted(out)


def test_page_memory_is_kept_by_bucket_and_forgets_as_by_url(spark, tmp_path):
    import random

    rng, name = random.Random(5), "spark.sql.streaming.stateStore.providerClass"
    hours = [(0, 0), (20, 45), (30, 60), (70, 75), (100, 130)]
    batches = [[(f"u{rng.randrange(40)}", rng.choice("ab"), 1000 + rng.randint(*h)) for _ in range(50)] for h in hours]
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        at, buckets, updated = f"file://{tmp_path}", 3, []
        for rows in batches:
            spark.createDataFrame(rows, "url string, content_hash string, hour long").selectExpr("url", "content_hash", "timestamp_seconds(hour * 3600) AS fetched_at").coalesce(1).write.mode("append").parquet(f"{at}/in")
            stream = incremental.page_changes(spark.readStream.schema("url string, content_hash string, fetched_at timestamp").parquet(f"{at}/in"), buckets=buckets)
            run = stream.writeStream.format("parquet").option("checkpointLocation", f"{at}/ck").trigger(availableNow=True).start(f"{at}/out")
            run.awaitTermination()
            updated += [p["stateOperators"][0]["numRowsUpdated"] for p in run.recentProgress]
        got = spark.read.schema("url string, content_hash string, fetched_at timestamp, change string").parquet(f"{at}/out").selectExpr("url", "content_hash", "unix_seconds(fetched_at) DIV 3600 AS hour", "change")
        assert sorted(map(tuple, got.collect())) == _changes_by_hand(batches, 48 * 3_600_000)
        assert updated and max(updated) <= 4 * buckets  # a value and both keys of a timer, not one of each URL
    finally:
        spark.conf.unset(name)


def test_parsed_pages_of_a_batch_are_stored_until_both_are_written(spark, tmp_path, monkeypatch):
    from pyspark.errors import StreamingQueryException

    at, plans, real = f"file://{tmp_path}", [], incremental.page_findings
    spark.createDataFrame([("https://h.com/Bad_Slug", "<p>short</p>"), ("https://h.com/ok", None)], "url string, html string").write.parquet(f"{at}/in")
    run = lambda: incremental.audit_batches(incremental.read_page_stream(spark, f"{at}/in", "url string, html string"), f"{at}/found", f"{at}/errors", f"{at}/ck").awaitTermination()

    def fails(pages):
        plans.append(pages._jdf.queryExecution().toString())
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(incremental, "page_findings", fails)
        with pytest.raises(StreamingQueryException):
            run()
    assert len(plans) == 1 and "MapInArrow" not in plans[0] and "InMemoryRelation" not in plans[0]  # rules read files, not a cache
    assert (tmp_path / "ck-parsed" / "batch=0" / "_SUCCESS").exists()
    run()
    assert {r.url for r in spark.read.parquet(f"{at}/found").collect()} == {"https://h.com/Bad_Slug", "https://h.com/ok"}
    assert spark.read.parquet(f"{at}/found").count() == real(incremental.extract_pages(spark.read.parquet(f"{at}/in"))).count()
    assert not list((tmp_path / "ck-parsed").glob("batch=*"))
