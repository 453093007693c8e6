import hashlib
import random
import subprocess
import sys

from pyspark.sql import functions as F

from siftwell.llm import warc


def pages(spark):
    big, bigger = "<p>é</p>" * 200, "x" * 100_000
    rows = [
        (1, "http://b.example.com/x?q=1#f", big), (2, "http://a.example.com/", big), (3, "http://a.example.com/", "small"), (4, "http://a.example.com/", "small"),
        (5, None, None), (6, "no scheme", ""), (7, "http://z.org/a\r\nb%", bigger), (8, "http://z.org/", big), (8, "http://z.org/", big), (None, "http://z.org/", big),
        (None, "http://null.org/", bigger + "y"), (None, "http://null.org/", bigger + "y"),
    ]
    rows += [(100 + i, f"http://h{i % 7}.net/{i % 11}", f"text {i % 5} " * 300) for i in range(200)]
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, html string, digest string, keep string")


def brute(rows):
    keep = {}
    for r in rows:
        h = r.html or ""
        if len(h.encode()) >= 1000:
            keep.setdefault(h, []).append(r.page_id)
    out = []
    for r in rows:
        h = r.html or ""
        best = max((p for p in keep.get(h, []) if p is not None), default=None)
        revisit = best is not None and r.page_id != best
        out.append((r.page_id, len(h.encode()), hashlib.sha1(h.encode()).hexdigest(), "revisit" if revisit else "response", best if revisit else None))
    return sorted(out, key=str)


def test_round_trip_revisits_and_order(spark, tmp_path):
    df = pages(spark).repartition(5).withColumn("captured", F.timestamp_seconds(F.coalesce(F.col("page_id"), F.lit(0)) % 9))
    folder = f"file://{tmp_path}/arc"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index = warc.write_archives(df, folder)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = warc.read_archives(index, payloads=True).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute(df.collect())
    assert all(r.intact for r in got)
    keys = [(r.url_key, r.captured, r.page_id is None, r.page_id or 0) for r in got]
    assert keys == sorted(keys)
    assert {r.url_key for r in got} >= {"com,example,a)/", "com,example,b)/x?q=1", "", "no scheme"}
    whole = {r.page_id: (r.html or "").encode() for r in df.collect()}
    assert all(bytes(r.payload) == whole[r.page_id] for r in got if r.record_type == "response" and r.page_id is not None)
    blocks = sorted((r["run"], r.block, tuple(r["first"]), tuple(r["last"])) for r in index.collect())
    assert all(a[3] <= b[2] for a, b in zip(blocks, blocks[1:]) if a[0] == b[0]) and len({b[0] for b in blocks}) > 1
    sizes = subprocess.run([sys.executable, "-c", "import gzip,glob,sys;print(sum(gzip.open(f).read().count(b'WARC/1.1\\r\\n') for f in glob.glob(sys.argv[1])))", f"{tmp_path}/arc/*.warc.gz"], capture_output=True, text=True)
    assert int(sizes.stdout) == len(got)


def test_many_ranges_and_blocks_keep_the_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "slots", lambda rows, per_slot: 13)
    rng = random.Random(4)
    rows = [(i, f"http://h{rng.randrange(9)}.org/{rng.randrange(40)}", "x" * rng.randrange(30)) for i in range(3000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).withColumn("captured", F.timestamp_seconds(F.col("page_id") % 5))
    got = warc.read_archives(warc.write_archives(df, f"file://{tmp_path}/arc")).select("page_id", "url_key", "captured").collect()
    keys = [(r.url_key, r.captured, r.page_id) for r in got]
    assert keys == sorted(keys) and sorted(r.page_id for r in got) == list(range(3000))


def test_empty_table(spark):
    df = pages(spark).limit(0).withColumn("captured", F.current_timestamp())
    assert warc.read_archives(warc.write_archives(df)).count() == 0


def test_loser_tree_equals_sorting():
    rng = random.Random(9)
    for k in (0, 1, 2, 3, 7, 64, 65, 200):
        runs = [sorted((rng.randrange(50), rng.randrange(5)) for _ in range(rng.randrange(12))) for _ in range(k)]
        assert list(warc.merge_runs(runs)) == sorted(x for r in runs for x in r)


def test_broken_records_raise():
    import pytest

    whole = warc.record(1, "http://a/", "1970-01-01T00:00:00Z", b"abc", 3, hashlib.sha1(b"abc").hexdigest(), None, False)
    assert warc.parse_record(whole)[2] == b"abc"
    for bad in (b"", b"HTTP/1.1 200\r\n\r\n", whole[:-8]):
        with pytest.raises(ValueError):
            warc.parse_record(bad)


def test_uris_come_back_as_they_were():
    for url in ("http://h.com/a%20b", "http://h.com/%25?q=é#x", "http://h.com/a%0Db", "no scheme", " http://h.com/x"):
        head, _, _ = warc.parse_record(warc.record(1, url, "2024-01-01T00:00:00Z", b"x", 1, "00" * 20, None, False))
        assert head["warc-target-uri"] == url.strip()
    head, _, _ = warc.parse_record(warc.record(1, "http://h.com/a\r\nb", "2024-01-01T00:00:00Z", b"x", 1, "00" * 20, None, False))
    assert head["warc-target-uri"] == "http://h.com/a%0D%0Ab"
