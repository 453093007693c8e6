"""WARC archives: capture runs with local indexes, merged externally by URL key and time.

Writing. Each task sorts its captures by URL key and time and writes them as one run: an archive
of gzip members (one record each) in that order, and a run file with one index line for each, both in the shared folder.
Spark gets a row for every ``BLOCK`` lines: where they stand and their first and last key. A task attempt writes files of
its own name, and only attempts that Spark commits get their rows into the stored index, so lost executors leave at
most files nobody refers to. Payloads move only to learn which record holds a repeated one, by id.

Merging. The keys at the ends of all blocks are cut into ranges. The task of a range reads each run file from the block where the range
begins to the one where it ends, a block at a time, and merges the runs with a loser tree; so it holds one block of each run,
however many lines the range has. Ranges in order and captures in order inside them are the
global order. Records are read by the merged index through a bounded set of open files.

Equal payloads of at least ``least`` bytes are stored once, by the largest id; the others are revisits
that keep the response's headers, and so its length. Null payloads count as empty, null URLs
have the empty key, null ids are never referred to unless all ids of a payload are null (then all are responses).
Repeated rows are records of their own. Batches are cut by bytes, so a very long payload is alone in its slice.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import math
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siftwell.llm.shared import shared_dir, slots, stored, text_slices
from siftwell.llm.urlfilter import host_of

OPEN_FILES = 64
BLOCK = 200  # index lines of a run that are read at once
KEY = "struct<url_key:string,captured:string,no_id:boolean,id:bigint>"
INDEX = f"run string, block long, start long, stop long, rows long, first {KEY}, last {KEY}"


def url_key(url: Column) -> Column:
    """Host labels from the top down, then path and query: ``org,example,www)/a?b``."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1), F.lit(""))
    labels = F.array_join(F.reverse(F.split(host_of(url), r"\.")), ",")
    return F.when(url.contains("://"), F.concat(labels, F.lit(")"), rest)).otherwise(F.coalesce(url, F.lit("")))


def record_id(page: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>"


def record(page: int | None, url: str | None, captured: str, payload: bytes, size: int, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One uncompressed record. ``digest``: hex SHA-1 of the full payload, whose length is ``size``."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page)}",
        f"WARC-Date: {captured}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page is not None:
        head.append(f"WARC-Page-ID: {page}")
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(refers_to)}",
            f"WARC-Refers-To-Page-ID: {refers_to}",
        ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers (keys in lower case) and payload of one record."""

    def fields(head: bytes) -> dict[str, str]:
        lines = head.decode("utf-8", "replace").split("\r\n")[1:]
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}

    head, _, rest = data.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    warc = fields(head)
    block = rest[: int(warc["content-length"])]
    if len(block) != int(warc["content-length"]):
        raise ValueError("record is cut")
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, fields(http), payload


def merge_runs(runs: list[Iterable[tuple]]) -> Iterator[tuple]:
    """Merge sorted runs with a loser tree: each inner node keeps the loser of its match, so a step costs one match a level."""
    heads = [iter(r) for r in runs]
    k = len(heads)
    if not k:
        return
    now = [next(h, None) for h in heads]
    losers = [-1] * k

    def before(a: int, b: int) -> bool:
        if now[a] is None or now[b] is None:
            return now[b] is None and (now[a] is not None or a < b)
        return (now[a], a) < (now[b], b)

    def replay(winner: int) -> int:
        node = (winner + k) // 2
        while node:
            if losers[node] == -1:
                losers[node] = winner
                return -1
            if before(losers[node], winner):
                losers[node], winner = winner, losers[node]
            node //= 2
        return winner

    champion = -1
    for i in range(k):
        champion = max(champion, replay(i))
    while now[champion] is not None:
        yield now[champion]
        now[champion] = next(heads[champion], None)
        champion = replay(champion)


def plan_records(df: DataFrame, id_col: str, url_col: str, payload_col: str, time_col: str, least: int) -> DataFrame:
    """id, url, url_key, captured, payload, size, digest, keep: the id whose record holds the payload, null for payloads that stand alone.

    Which payloads repeat is found from ids and digests; rows of payloads that may are joined to that by id and digest, so equal
    payloads do not meet in a task, and small payloads are not moved at all.
    """
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = df.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(url_col).alias("url"),
        url_key(F.col(url_col)).alias("url_key"),
        F.coalesce(F.date_format(F.col(time_col), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("1970-01-01T00:00:00Z")).alias("captured"),
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("size"),
        F.sha1(payload.cast("binary")).alias("digest"),
    )
    keyed = {"_id": F.coalesce("id", F.lit(0)), "_none": F.col("id").isNull()}
    big = rows.where(F.col("size") >= least)
    keepers = big.groupBy("digest").agg(F.max("id").alias("keep"), F.count("*").alias("_n")).where("_n > 1 and keep is not null").drop("_n")
    revisits = big.withColumns(keyed).select("_id", "_none", "digest").distinct().join(keepers, "digest")
    names = ["id", "url", "url_key", "captured", "payload", "size", "digest"]
    told = big.withColumns(keyed).join(revisits, ["_id", "_none", "digest"], "left").select(*names, "keep")
    return told.union(rows.where(F.col("size") < least).select(*names, F.lit(None).cast("long").alias("keep")))


def write_archives(
    df: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", time_col: str = "captured", least: int = 1000
) -> DataFrame:
    """Write all rows as archives and run files below ``folder`` (default: a new shared one); returns the stored index of the runs' blocks."""
    folder = folder or shared_dir(df.sparkSession, "warc")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        name, out, lines = f"run-{uuid.uuid4().hex}", None, None
        offset = place = block = 0
        keys, blocks = [], []

        def close_block(start: int) -> None:
            nonlocal block
            as_key = lambda k: dict(zip(("url_key", "captured", "no_id", "id"), k))
            blocks.append({"run": name, "block": block, "start": start, "stop": place, "rows": len(keys), "first": as_key(keys[0]), "last": as_key(keys[-1])})
            block += 1
            keys.clear()

        began = 0
        for whole in batches:
            for batch in text_slices(whole, whole.schema.get_field_index("payload")):
                for r in batch.to_pylist():
                    if out is None:
                        store.create_dir(base, recursive=True)
                        out = store.open_output_stream(f"{base}/{name}.warc.gz", compression=None)
                        lines = store.open_output_stream(f"{base}/{name}.cdxj", compression=None)
                    revisit = r["keep"] is not None and r["id"] != r["keep"]
                    payload = b"" if revisit else r["payload"].encode()
                    data = gzip.compress(record(r["id"], r["url"], r["captured"], payload, r["size"], r["digest"], r["keep"], revisit), 4, mtime=0)
                    out.write(data)
                    key = (r["url_key"], r["captured"], r["id"] is None, r["id"] or 0)
                    line = json.dumps([*key, offset, len(data)]).encode() + b"\n"
                    lines.write(line)
                    offset, place = offset + len(data), place + len(line)
                    keys.append(key)
                    if len(keys) == BLOCK:
                        close_block(began)
                        began = place
        if keys:
            close_block(began)
        if out is not None:
            out.close()
            lines.close()
        key = pa.struct([("url_key", pa.string()), ("captured", pa.string()), ("no_id", pa.bool_()), ("id", pa.int64())])
        long = pa.int64()
        yield pa.RecordBatch.from_pylist(blocks, pa.schema([("run", pa.string()), ("block", long), ("start", long), ("stop", long), ("rows", long), ("first", key), ("last", key)]))

    runs = plan_records(df, id_col, url_col, payload_col, time_col, least).sortWithinPartitions("url_key", "captured", F.col("id").asc_nulls_last())
    return stored(runs.mapInArrow(run, INDEX), "cdx").withColumn("folder", F.lit(folder))


class _Files:
    """At most ``OPEN_FILES`` open files of a folder, least recently used closed first."""

    def __init__(self, folder: str):
        from pyarrow import fs

        self.store, self.base = fs.FileSystem.from_uri(folder)
        self.open: OrderedDict = OrderedDict()

    def read(self, path: str, offset: int, length: int) -> bytes:
        if path in self.open:
            self.open.move_to_end(path)
        else:
            self.open[path] = self.store.open_input_file(f"{self.base}/{path}")
            if len(self.open) > OPEN_FILES:
                self.open.popitem(last=False)[1].close()
        self.open[path].seek(offset)
        return self.open[path].read(length)


    def lines(self, run: str, blocks: list[tuple[int, int]], low: tuple, high: tuple | None) -> Iterator[tuple]:
        """(key, run, offset, length) of the run's captures from ``low`` on and before ``high``, read block by block."""
        for start, stop in blocks:
            for line in self.read(f"{run}.cdxj", start, stop - start).splitlines():
                *key, offset, length = json.loads(line)
                key = tuple(key)
                if high is not None and key >= high:
                    return
                if key >= low:
                    yield key, run, offset, length


def merge_ranges(index: DataFrame) -> DataFrame:
    """part, low, high (null: none), run, start, stop: the blocks that each range of keys needs, a partition for each range, in order."""
    n_rows = index.agg(F.sum("rows")).first()[0] or 0
    n_parts = slots(n_rows, max(4_000, 20 * math.isqrt(n_rows)))
    ends = index.select("run", "block", F.explode(F.array("first", "last")).alias("key")).repartitionByRange(n_parts, "key")
    ends = stored(ends.withColumn("part", F.spark_partition_id()), "ends")
    lows = ends.groupBy("part").agg(F.min("key").alias("low"))
    after = W.partitionBy(F.lit(0)).orderBy("part")  # one row a range
    lows = lows.select("part", "low", F.lead("low").over(after).alias("high"))
    spans = ends.groupBy("run", "block").agg(F.min("part").alias("a"), F.max("part").alias("b"))
    needed = spans.select("run", "block", F.explode(F.sequence("a", "b")).alias("part")).join(lows, "part").join(index, ["run", "block"])
    needed = needed.select("part", "low", "high", "run", "block", "start", "stop", "folder")
    return needed.repartitionByRange(n_parts, "part").sortWithinPartitions("part", "run", "block")


def read_archives(index: DataFrame, payloads: bool = False) -> DataFrame:
    """Records of all runs in order of (URL key, time, id), read by the merged index.

    page id, url_key, captured, file, offset, record_type, payload_bytes, payload_digest (hex; recomputed for
    responses), intact (digest and length as the headers say), refers_to and, if asked for, payload.
    """
    schema = (
        "page_id long, url_key string, captured string, file string, offset long, record_type string, payload_bytes long, "
        "payload_digest string, intact boolean, refers_to long" + ", payload binary" * payloads
    )

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.int64()] + [pa.binary()] * payloads
        names = [x.split()[0] for x in schema.split(", ")]
        files: _Files | None = None

        def ranges() -> Iterator[tuple]:
            """(folder, low, high, blocks of each run) of each range; its block rows follow each other."""
            now, head, runs = None, None, {}
            for batch in batches:
                for r in batch.to_pylist():
                    if r["part"] != now:
                        if runs:
                            yield *head, runs
                        as_key = lambda k: tuple(k.values()) if k else None
                        now, head, runs = r["part"], (r["folder"], as_key(r["low"]), as_key(r["high"])), {}
                    runs.setdefault(r["run"], []).append((r["start"], r["stop"]))
            if runs:
                yield *head, runs

        for folder, low, high, runs in ranges():
            files = files or _Files(folder)
            rows, held = [], 0
            for (key, captured, no_id, page), name, offset, length in merge_runs([files.lines(r, b, low, high) for r, b in runs.items()]):
                file = f"{name}.warc.gz"
                warc, http, payload = parse_record(zlib.decompress(files.read(file, offset, length), 31))
                told = base64.b32decode(warc["warc-payload-digest"].removeprefix("sha1:")).hex()
                kind, size = warc["warc-type"], int(http["content-length"])
                digest = hashlib.sha1(payload).hexdigest() if kind == "response" else told
                intact = kind != "response" or digest == told and len(payload) == size
                same = warc.get("warc-page-id")
                refers = warc.get("warc-refers-to-page-id")
                rows.append((int(same) if same else None, key, captured, file, offset, kind, len(payload) if kind == "response" else size, digest, intact and (same is None) == no_id and (no_id or int(same) == page), int(refers) if refers else None, *([payload] * payloads)))
                held += len(payload) * payloads
                if len(rows) == 500 or held > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return merge_ranges(index).mapInArrow(run, schema)
