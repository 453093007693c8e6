"""Media columns: ISO media containers written and probed without decoding payloads.

``mux_payload`` stores bytes as an audio track of 8-bit samples (``raw `` sample entry, 64
samples a sample-table entry); ``probe_media`` walks the nested boxes, decodes the sample
tables and gives codec, duration and the byte ranges of the key frames. The payload is
never decoded: it is read back by the sample tables alone.

Null texts count as empty; the payload of an empty text is one unit of zero bytes.
Very long texts are long containers; repeated rows give equal ones. Broken containers (cut boxes, impossible sizes, missing tables) give null columns, not a failure.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = 64
RATE = 8000
KEY_EVERY = 16
CONTAINERS = frozenset({b"moov", b"trak", b"mdia", b"minf", b"stbl"})

PROBE_FIELDS = (
    "codec string, timescale long, duration long, n_samples long, "
    "keyframes array<struct<number:long,start:long,size:long>>, payload binary"
)


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % UNIT or (0 if data else UNIT))


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def mux_payload(payload: bytes, key_every: int = KEY_EVERY) -> bytes:
    """A container with one track whose samples of ``UNIT`` bytes hold ``payload``."""
    import numpy as np

    count = len(payload) // UNIT
    frames = count * UNIT
    matrix = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    entry = _box(b"raw ", bytes(6), struct.pack(">HHHIHHHHI", 1, 0, 0, 0, 1, 8, 0, 0, RATE << 16))
    keys = np.arange(1, count + 1, key_every, dtype=">u4")

    def movie(start: int) -> bytes:
        table = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, count, UNIT)),
            _full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            _full(b"stsc", struct.pack(">IIII", 1, 1, count, 1)),
            _full(b"stsz", struct.pack(">II", UNIT, count)),
            _full(b"co64", struct.pack(">IQ", 1, start)),
        )
        info = _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), table)
        media = _box(
            b"mdia",
            _full(b"mdhd", struct.pack(">QQIQHH", 0, 0, RATE, frames, 0x55C4, 0), version=1),
            _full(b"hdlr", bytes(4), b"soun", bytes(12), b"\0"),
            info,
        )
        track = _box(b"trak", _full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, frames), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), matrix, bytes(8), version=1, flags=3), media)
        head = _full(b"mvhd", struct.pack(">QQIQIH", 0, 0, RATE, frames, 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2), version=1)
        return _box(b"moov", head, track)

    kind = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")
    mdat = _box(b"mdat", payload)
    start = len(kind) + len(movie(0)) + len(mdat) - len(payload)
    return kind + movie(start) + mdat


def walk_boxes(data, start: int = 0, end: int | None = None, path: tuple = ()) -> Iterator[tuple[tuple, int, int]]:
    """(path of kinds, start of the body, its end) of every box, containers before their children."""
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            (size,), head = struct.unpack_from(">Q", data, start + 8), 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise ValueError(f"box {kind!r} at {start} is cut")
        here = (*path, kind)
        yield here, start + head, start + size
        if kind in CONTAINERS:
            yield from walk_boxes(data, start + head, start + size, here)
        start += size


def probe(data: bytes) -> dict | None:
    """Codec, time scale, duration, sample count, key-frame ranges and payload of the first track; None if broken."""
    import numpy as np

    try:
        found: dict[bytes, int] = {}
        for path, body, _ in walk_boxes(data):
            found.setdefault(path[-1], body)
            if path[-1] == b"trak" and b"stbl" in found:
                break
        at = found[b"mdhd"]
        timescale, duration = struct.unpack_from(">IQ", data, at + 20) if data[at] == 1 else struct.unpack_from(">II", data, at + 12)
        codec = bytes(data[found[b"stsd"] + 12 : found[b"stsd"] + 16]).decode("latin-1")
        fixed, count = struct.unpack_from(">II", data, found[b"stsz"] + 4)
        if fixed * count > len(data):
            raise ValueError("more samples than bytes")
        if fixed:
            sizes = np.full(count, fixed, dtype=np.int64)
        else:
            sizes = np.frombuffer(data, ">u4", count, found[b"stsz"] + 12).astype(np.int64)
        kind, width = (b"co64", ">u8") if b"co64" in found else (b"stco", ">u4")
        (n_chunks,) = struct.unpack_from(">I", data, found[kind] + 4)
        chunks = np.frombuffer(data, width, n_chunks, found[kind] + 8).astype(np.int64)
        (n_runs,) = struct.unpack_from(">I", data, found[b"stsc"] + 4)
        runs = np.frombuffer(data, ">u4", 3 * n_runs, found[b"stsc"] + 8).reshape(-1, 3).astype(np.int64)
        per_chunk = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], n_chunks + 1)))
        if per_chunk.sum() > len(data) or sizes.sum() > len(data):
            raise ValueError("more samples than bytes")
        chunk_of = np.repeat(np.arange(n_chunks), per_chunk)[:count]
        before = np.cumsum(sizes) - sizes
        first = np.cumsum(per_chunk) - per_chunk
        starts = chunks[chunk_of] + before - before[first[chunk_of]]
        if len(starts) != count or count and (starts.min() < 0 or (starts + sizes).max() > len(data)):
            raise ValueError("samples beyond the end")
        if b"stss" in found:
            (n_keys,) = struct.unpack_from(">I", data, found[b"stss"] + 4)
            keys = np.frombuffer(data, ">u4", n_keys, found[b"stss"] + 8).astype(np.int64) - 1
        else:
            keys = np.arange(count)
        if len(keys) and not 0 <= keys.min() <= keys.max() < count:
            raise ValueError("key frames beyond the samples")
        joins = np.flatnonzero(np.append(True, starts[1:] != starts[:-1] + sizes[:-1])) if count else np.array([], int)
        stops = np.append(joins[1:], count) - 1
        payload = b"".join(data[starts[a] : starts[b] + sizes[b]] for a, b in zip(joins, stops))
    except (KeyError, ValueError, struct.error, IndexError, RecursionError):
        return None
    return {
        "codec": codec, "timescale": timescale, "duration": duration, "n_samples": int(count),
        "keyframes": [{"number": int(k) + 1, "start": int(starts[k]), "size": int(sizes[k])} for k in keys],
        "payload": payload,
    }


def texts_to_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes (UTF-8 length of the text) and ``media``, the container that holds it."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from siftwell.llm.shared import text_slices

        for whole in batches:
            for batch in text_slices(whole, 1):
                texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([mux_payload(padded(t)) for t in texts], pa.binary())],
                    names=["id", "n_bytes", "media"],
                )

    out = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, media binary")
    return out.withColumnRenamed("id", id_col)


def probe_media(df: DataFrame, media_col: str = "media", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns, the media and what the boxes say of it; null fields where the container is broken.

    Columns to keep that are named like one of these results are left out.
    """
    results = {"media", *(x.split()[0] for x in PROBE_FIELDS.split(", "))}
    kept = [f for f in df.schema.fields if f.name in keep and f.name not in results]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "media binary", PROBE_FIELDS])
    names = [f.name for f in kept]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from siftwell.llm.shared import text_slices

        item = pa.struct([("number", pa.int64()), ("start", pa.int64()), ("size", pa.int64())])
        types = {"codec": pa.string(), "timescale": pa.int64(), "duration": pa.int64(), "n_samples": pa.int64(), "keyframes": pa.list_(item), "payload": pa.binary()}
        for whole in batches:
            for batch in text_slices(whole, len(names)):
                got = [probe(m) or {} if m is not None else {} for m in batch.column(len(names)).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, *(pa.array([g.get(k) for g in got], t) for k, t in types.items())], names=[*names, "media", *types]
                )

    return df.select(*[F.col(n) for n in names], F.col(media_col).alias("media")).mapInArrow(run, schema)

