"""Exact n-gram Jaccard join by universe partitioning and the pigeonhole principle.

Two sets of x and y shingles link when 100 * |intersection| >= 75 * |union|, that is
7 * |intersection| >= 3 * (x + y). The steps:

1. *Classes.* Equal sets are one class, whose id is a 64-bit sum over its shingles.
2. *Rare shingles.* A shingle of one class alone is in no intersection. Shingles are dealt to
   buckets in packed batches; those seen in two classes are sent back. A batch that sees a
   shingle twice itself sends one witness in place of all copies, so a very common shingle costs
   a few bytes per batch. Classes with too few shared shingles can link with nothing and leave.
3. *Segments.* Sizes fall into bands that grow by a third. A band's universe is hashed into
   segments; for sets that link, the number of differing shingles is bounded, so if every
   segment i may differ by a_i and the (a_i + 1) add up to the bound plus one, some segment
   keeps its promise. A set indexes its segments and their one-deletion neighbours in its own
   band. It probes its own and the neighbouring bands for sets with as many shared shingles or
   more, with the allocation of -1 (skipped), 0 or 1 that is cheapest by the counted lengths of
   the lists. A much edited copy in a large group of copies thus looks in the short lists of its
   edits and not in the long ones of the text that all have.
4. *Candidates.* Each distinct set of classes that meet in a signature gives its pairs if it is
   small. A larger one gives a star around its fullest member; after that only
   pairs whose ends are still in different components are formed, so no link that could join
   components is lost and a large group of near copies costs little more than its size.
5. *Verification* compares the shared shingles of both classes exactly, first of each class with the partner that has
   most candidates, then of all pairs whose ends are still apart; components are found by
   alternating star contraction over the verified links, in tables.

Nulls and texts without words have no shingles and are alone. Null ids are rows like others but never
name a component unless the whole class has no id. Repeated rows are one class; very long texts are sets like
others, and blocks of comparison are cut by bytes as well as by number. Shingles are compared by all 64 bits of
their hash, classes are named by a 64-bit sum; signatures carry 40 bits and more, which only adds candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import LongType, StructField, StructType

from siftwell.llm.shared import discard, named_again, numbered_columns, stored

SLICE = 2 << 20  # bytes of text worked on at once
BLOCK = 250  # pairs that are compared in one group, about
BLOCK_BYTES = 4 << 20  # bytes of sets in one group, about
BUCKET = 2_000_000  # values that a bucket holds on average
ALL_PAIRS = 6  # largest set of classes that is expanded to all pairs at once
INDEXED, NEIGHBOUR, EXACT, NEAR, SHORTER = range(5)  # roles of a signature, in its lowest bits
ROLELESS = ~7 & (1 << 64) - 1  # a signature without its role
BLOBS = "key long, cids binary, sizes binary, counts binary, values binary, witnesses binary"


def _pack(values):
    """The low 40 bits of each value."""
    import numpy as np

    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _unpack(data: bytes):
    import numpy as np

    out = np.zeros((len(data) // 5, 8), dtype=np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def _bucket(values, n: int):
    import numpy as np

    return (((values >> np.uint64(40)) * np.uint64(n)) >> np.uint64(24)).astype(np.int64)


def _class_id(shingles) -> int:
    from siftwell.llm.shingles import mix

    return int(mix(shingles).sum(dtype="u8").astype("i8")) if len(shingles) else 0


def _batch(names: str, rows: list[tuple]):
    import pyarrow as pa

    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [x.split() for x in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows) if rows else [[]] * len(fields), fields)], names=[n for n, _ in fields])


def row_classes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, n (distinct shingles) and cid of each row."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from siftwell.llm.shared import text_slices
        from siftwell.llm.shingles import of_arrow

        for whole in batches:
            for batch in text_slices(whole, 1, SLICE):
                sets = of_arrow(batch.column(1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([_class_id(s) for s in sets], pa.int64())], names=["id", "n", "cid"]
                )

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n long, cid long")


def shared_shingles(df: DataFrame, text_col: str, n_values: int) -> DataFrame:
    """cid, n and values of the classes that may link: those with 3 in 4 shingles, at least, seen in another class."""
    n_buckets = max(1, -(-n_values // BUCKET))

    def deal(batches: Iterator) -> Iterator:
        import numpy as np

        from siftwell.llm.shared import text_slices
        from siftwell.llm.shingles import of_arrow

        for whole in batches:
            for batch in text_slices(whole, 0, SLICE):
                sets = {_class_id(s): s for s in of_arrow(batch.column(0)) if len(s)}
                if not sets:
                    continue
                cids = np.array(list(sets), dtype=np.int64)
                sizes = np.array([len(s) for s in sets.values()], dtype=np.int64)
                values = np.concatenate(list(sets.values()))
                owner = np.repeat(np.arange(len(cids)), sizes)
                distinct, place, times = np.unique(values, return_inverse=True, return_counts=True)
                twice = times[place] > 1
                bucket = _bucket(values, n_buckets)
                # sizes of all classes, and the shingles that this batch has seen twice, go to the class's part
                part = (cids.view(np.uint64) % np.uint64(n_buckets)).astype(np.int64)
                rows = []
                order = np.argsort(part[owner], kind="stable")
                order = order[twice[order]]
                parts, of_part = np.unique(part), np.argsort(part, kind="stable")
                for p, at, mine in zip(parts, _slices(part[owner][order], order, parts), _slices(part[of_part], of_part, parts)):
                    counts = np.bincount(owner[at], minlength=len(cids))[mine]
                    rows.append((int(n_buckets + p), cids[mine].tobytes(), sizes[mine].astype(np.int32).tobytes(), counts.astype(np.int32).tobytes(), values[at].tobytes(), b""))
                once = np.flatnonzero(~twice)
                once = once[np.argsort(bucket[once], kind="stable")]
                seen = distinct[times > 1]
                seen_bucket = _bucket(seen, n_buckets)
                seen_order = np.argsort(seen_bucket, kind="stable")
                present = np.union1d(bucket[once], seen_bucket)
                for b, at, witness in zip(present, _slices(bucket[once], once, present), _slices(seen_bucket[seen_order], seen[seen_order], present)):
                    who, counts = np.unique(owner[at], return_counts=True)
                    rows.append((int(b), cids[who].tobytes(), b"", counts.astype(np.int32).tobytes(), values[at].tobytes(), witness.tobytes()))
                yield _batch(BLOBS, rows)

    def settle(table):
        """Shingles of a bucket that two classes have, dealt to the parts of their classes."""
        import numpy as np
        import pyarrow as pa

        from siftwell.llm.shared import give_back

        give_back()
        key = table.column("key")[0].as_py()
        if key >= n_buckets:
            return pa.Table.from_batches(table.drop_columns(["witnesses"]).to_batches()).set_column(0, "key", pa.array([key - n_buckets] * table.num_rows, pa.int64()))
        join = lambda name: b"".join(x.as_py() for x in table.column(name))
        cids = np.frombuffer(join("cids"), np.int64)
        counts = np.frombuffer(join("counts"), np.int32)
        values, witnesses = np.frombuffer(join("values"), np.uint64), np.frombuffer(join("witnesses"), np.uint64)
        owner = np.repeat(cids, counts)
        order = np.argsort(values)
        values, owner = values[order], owner[order]
        rows = []
        if len(values):
            first = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
            shared = np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first)
            if len(witnesses):
                witnesses = np.unique(witnesses)
                at = np.minimum(np.searchsorted(witnesses, values[first]), len(witnesses) - 1)
                shared |= witnesses[at] == values[first]
            shared = np.repeat(shared, np.diff(np.append(first, len(values))))
            values, owner = values[shared], owner[shared]
            part = (owner.view(np.uint64) % np.uint64(n_buckets)).astype(np.int64)
            order = np.lexsort((owner, part))
            values, owner, part = values[order], owner[order], part[order]
            parts = np.unique(part)
            for p, mine, of in zip(parts, _slices(part, values, parts), _slices(part, owner, parts)):
                who, counts = np.unique(of, return_counts=True)
                rows.append((int(p), who.tobytes(), b"", counts.astype(np.int32).tobytes(), mine.tobytes()))
        return pa.Table.from_batches([_batch("key long, cids binary, sizes binary, counts binary, values binary", rows)])

    def gather(table):
        """Classes of a part with enough shared shingles."""
        import numpy as np
        import pyarrow as pa

        size: dict[int, int] = {}
        owners, values = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for r in table.to_pylist():
            cids = np.frombuffer(r["cids"], np.int64)
            if r["sizes"]:
                size.update(zip(cids.tolist(), np.frombuffer(r["sizes"], np.int32).tolist()))
            owners.append(np.repeat(cids, np.frombuffer(r["counts"], np.int32)))
            values.append(np.frombuffer(r["values"], np.uint64))
        owner, value = np.concatenate(owners), np.concatenate(values)
        order = np.lexsort((value, owner))
        owner, value = owner[order], value[order]
        rows = []
        if len(owner):
            keep = np.append(True, (owner[1:] != owner[:-1]) | (value[1:] != value[:-1]))
            owner, value = owner[keep], value[keep]
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            for a, b in zip(first, np.append(first[1:], len(owner))):
                n = size[int(owner[a])]
                if 4 * (b - a) >= 3 * n:
                    rows.append((int(owner[a]), n, value[a:b].tobytes()))
        return pa.Table.from_batches([_batch("cid long, n int, shared binary", rows)])

    blobs = df.select(F.col(text_col).alias("text")).mapInArrow(deal, BLOBS)
    settled = blobs.groupBy("key").applyInArrow(settle, "key long, cids binary, sizes binary, counts binary, values binary")
    return settled.groupBy("key").applyInArrow(gather, "cid long, n int, shared binary")


def band_starts(largest: int) -> list[int]:
    """Smallest sizes of the bands: a set links with sets of its own band and the neighbouring ones alone."""
    starts = [1]
    while starts[-1] <= largest:
        starts.append(starts[-1] * 4 // 3 + 1)
    return starts


def segments_of(start: int, end: int) -> int:
    """Segments of a band of sizes start..end: about one for each shingle by which two sets of the smallest size may differ."""
    most = max((2 * end) // 7, (end * 4 // 3 + end) // 7)
    return max(2 * start // 7 + 1, -(-(most + 1) // 2))


def allocate(lists, sizes, need: int):
    """a_i of -1, 0 or 1: the (a_i + 1) add up to ``need``, at the least cost.

    ``lists``: how many sets index just this segment. One deletion more is taken to cost that for the segment and each of its neighbours.
    """
    import numpy as np

    exact = lists + 0.01
    steps = np.concatenate([exact, 4 * (exact + 1) * (sizes + 2)])
    chosen = np.argsort(steps, kind="stable")[:need]
    return np.bincount(chosen % len(sizes), minlength=len(sizes)) - 1


def probed_bands(n: int, shared: int, starts: list[int]) -> list[tuple[int, int]]:
    """(band, need) of a set of n shingles, ``shared`` of them shared: where it looks for sets with as many shared ones or more.

    need: one more than the number of shared shingles by which it may differ from a set of that band and link with it.
    """
    import numpy as np

    own = int(np.searchsorted(starts, n, side="right")) - 1
    out = []
    for k in range(max(own - 1, 0), min(own + 2, len(starts) - 1)):
        largest = min(starts[k + 1] - 1, 4 * n // 3)
        need = (7 * shared - 6 * n + largest) // 7 + 1
        if need > 0 and largest >= max(starts[k], shared) and 4 * largest >= 3 * n:
            out.append((k, need))
    return out


def segment_hashes(values, k: int, starts: list[int]):
    """Signature of each segment of a set in band k; of each shingle's segment without it; its segment; sizes of segments."""
    import numpy as np

    from siftwell.llm.shingles import mix

    m = segments_of(starts[k], starts[k + 1] - 1)
    mixed = mix(values + np.uint64(k * 0x9E3779B1 & 0xFFFFFFFF))
    segment = (((mixed >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(segment, kind="stable")
    mixed, segment = mixed[order], segment[order]
    sizes = np.bincount(segment, minlength=m)
    running = np.append(np.uint64(0), np.cumsum(mixed, dtype=np.uint64))
    ends = np.cumsum(sizes)
    sums = running[ends] - running[ends - sizes]
    salt = mix(np.arange(m, dtype=np.uint64) + np.uint64((k + 1) << 32))
    return mix(sums ^ salt) & np.uint64(ROLELESS), mix((sums[segment] - mixed) ^ salt[segment]) & np.uint64(ROLELESS), segment, sizes


def index_entries(n: int, values, starts: list[int]):
    """Signatures with roles INDEXED and NEIGHBOUR of a set, in its own band."""
    import numpy as np

    whole, less, _, _ = segment_hashes(values, int(np.searchsorted(starts, n, side="right")) - 1, starts)
    return np.concatenate([whole | np.uint64(INDEXED), less | np.uint64(NEIGHBOUR)])


def probe_entries(n: int, values, starts: list[int], frequency):
    """Signatures with roles EXACT, NEAR and SHORTER. ``frequency``: lists of the signatures of the bands probed, in their order."""
    import numpy as np

    out, at = [np.zeros(0, np.uint64)], 0
    for k, need in probed_bands(n, len(values), starts):
        whole, less, segment, sizes = segment_hashes(values, k, starts)
        a = allocate(frequency[at : at + len(whole)], sizes, need)
        at += len(whole)
        out += [whole[a == 0] | np.uint64(EXACT), whole[a == 1] | np.uint64(NEAR), less[a[segment] == 1] | np.uint64(SHORTER)]
    return np.concatenate(out)


def _slices(keys, rows, wanted) -> Iterator:
    """The ``rows`` of each wanted key, where ``keys`` rise with them: the work follows the rows, not the number of keys there could be."""
    import numpy as np

    for a, b in zip(np.searchsorted(keys, wanted, side="left"), np.searchsorted(keys, wanted, side="right")):
        yield rows[a:b]


def _dealt(found: list, cids, extra, n_buckets: int, places: list | None = None) -> list[tuple]:
    """Rows of ``BLOBS``: the values of each set of a batch, by bucket. ``extra``: a number of each set that goes along, ``places``: one of each value."""
    import numpy as np

    place = np.concatenate(places).astype(np.int32) if places else None
    value, owner = np.concatenate(found), np.repeat(np.arange(len(found)), [len(f) for f in found])
    bucket = _bucket(value, n_buckets)
    order = np.argsort(bucket, kind="stable")
    rows, present = [], np.unique(bucket)
    for b, at in zip(present, _slices(bucket[order], order, present)):
        who, counts = np.unique(owner[at], return_counts=True)
        rows.append((int(b), cids[who].tobytes(), extra[who].tobytes(), counts.astype(np.int32).tobytes(), _pack(value[at]), place[at].tobytes() if places else b""))
    return rows


def _opened(table):
    """Owner, its extra number, and value of every entry of a bucket."""
    import numpy as np

    from siftwell.llm.shared import give_back

    give_back()  # what the group before has left
    join = lambda name: b"".join(x.as_py() for x in table.column(name))
    counts = np.frombuffer(join("counts"), np.int32)
    return np.repeat(np.frombuffer(join("cids"), np.int64), counts), np.repeat(np.frombuffer(join("sizes"), np.int32), counts), _unpack(join("values"))


def list_lengths(kept: DataFrame, starts: list[int], n_buckets: int) -> DataFrame:
    """cid, frequency: for each place among the segments that the set may probe, how many sets index it."""

    def deal(batches: Iterator) -> Iterator:
        import numpy as np

        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                found, cids, places = [], [], []
                for r in batch.slice(start, 500).to_pylist():
                    values = np.frombuffer(r["shared"], np.uint64)
                    own = segment_hashes(values, int(np.searchsorted(starts, r["n"], side="right")) - 1, starts)[0]
                    asked = [segment_hashes(values, k, starts)[0] | np.uint64(EXACT) for k, _ in probed_bands(r["n"], len(values), starts)]
                    found.append(np.concatenate([own | np.uint64(INDEXED), *asked]))
                    places.append(np.append(np.full(len(own), -1), np.arange(len(found[-1]) - len(own))))
                    cids.append(r["cid"])
                if found:
                    yield _batch(BLOBS, _dealt(found, np.array(cids, dtype=np.int64), np.zeros(len(cids), np.int32), n_buckets, places))

    def count(table):
        import numpy as np
        import pyarrow as pa

        owner, _, value = _opened(table)
        place = np.frombuffer(b"".join(x.as_py() for x in table.column("witnesses")), np.int32)
        asked = place >= 0
        indexed = np.sort(value[~asked] & np.uint64(ROLELESS))
        wanted = value[asked] & np.uint64(ROLELESS)
        n = np.searchsorted(indexed, wanted, side="right") - np.searchsorted(indexed, wanted, side="left")
        owner, place = owner[asked], place[asked]
        order = np.argsort(owner, kind="stable")
        owner, place, n = owner[order], place[order], n[order]
        who, counts = np.unique(owner, return_counts=True)
        ends = np.cumsum(counts)
        rows = [(int(c), place[a:b].astype(np.int32).tobytes(), n[a:b].astype(np.int32).tobytes()) for c, a, b in zip(who, ends - counts, ends)]
        return pa.Table.from_batches([_batch("cid long, places binary, lists binary", rows)])

    counted = kept.select("cid", "n", "shared").mapInArrow(deal, BLOBS).groupBy("key").applyInArrow(count, "cid long, places binary, lists binary")
    return counted.groupBy("cid").agg(F.collect_list(F.struct("places", "lists")).alias("frequency"))  # one entry a bucket


def _frequency(parts: list | None):
    """Lists by place, from the answers of the buckets."""
    import numpy as np

    if not parts:
        return np.zeros(0, np.int32)
    places = np.concatenate([np.frombuffer(p["places"], np.int32) for p in parts])
    out = np.zeros(places.max() + 1, np.int32)
    out[places] = np.concatenate([np.frombuffer(p["lists"], np.int32) for p in parts])
    return out


def meeting_sets(kept: DataFrame) -> DataFrame:
    """Distinct sets of classes that meet in a signature: set, cid, shared, probes (or is indexed), members (how many)."""
    totals = kept.agg(F.max("n").alias("n"), F.sum(F.octet_length("shared") / 8).alias("values")).first()
    starts = band_starts(totals["n"] or 1)
    n_buckets = max(1, -(-int(4 * (totals["values"] or 0)) // BUCKET))
    lengths = list_lengths(kept, starts, n_buckets)

    def deal(batches: Iterator) -> Iterator:
        import numpy as np

        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                found, cids, shared = [], [], []
                for r in batch.slice(start, 500).to_pylist():
                    values = np.frombuffer(r["shared"], np.uint64)
                    probes = probe_entries(r["n"], values, starts, _frequency(r["frequency"]))
                    found.append(np.concatenate([index_entries(r["n"], values, starts), probes]))
                    cids.append(r["cid"])
                    shared.append(len(values))
                if found:
                    yield _batch(BLOBS, _dealt(found, np.array(cids, dtype=np.int64), np.array(shared, dtype=np.int32), n_buckets))

    def meet(table):
        import numpy as np
        import pyarrow as pa

        from siftwell.llm.shingles import mix

        owner, shared, value = _opened(table)
        role, value = (value & np.uint64(7)).astype(np.int64), value >> np.uint64(3)
        # roles that may meet: EXACT with INDEXED, NEAR with both, SHORTER with INDEXED
        parts = []
        for probing, indexed in (((EXACT, NEAR, SHORTER), (INDEXED,)), ((NEAR,), (NEIGHBOUR,))):
            is_probe, is_index = np.isin(role, probing), np.isin(role, indexed)
            use = is_probe | is_index
            key = np.lexsort((owner[use], is_probe[use], value[use]))
            v, o, p, x = value[use][key], owner[use][key], is_probe[use][key], shared[use][key]
            if len(v):
                keep = np.append(True, (v[1:] != v[:-1]) | (o[1:] != o[:-1]) | (p[1:] != p[:-1]))
                v, o, p, x = v[keep], o[keep], p[keep], x[keep]
                first = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
                several = np.minimum.reduceat(o, first) != np.maximum.reduceat(o, first)
                several &= np.logical_or.reduceat(p, first) & ~np.logical_and.reduceat(p, first)
                size = np.diff(np.append(first, len(v)))
                name = np.add.reduceat(mix(o.view(np.uint64) ^ (p.astype(np.uint64) << np.uint64(63)) ^ np.uint64(0x51ED27)), first).view(np.int64)
                names, one = np.unique(name[several], return_index=True)
                for s, i in zip(names, np.flatnonzero(several)[one]):
                    at = slice(first[i], first[i] + size[i])
                    parts.append((int(s), o[at].tobytes(), x[at].astype(np.int32).tobytes(), p[at].tobytes()))
        return pa.Table.from_batches([_batch("set long, cids binary, shared binary, probes binary", parts)])

    def members(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in (whole.slice(i, 200) for whole in batches for i in range(0, whole.num_rows, 200)):
            join = lambda i: b"".join(batch.column(i).to_pylist())  # noqa: E731, B023
            sizes = np.array([len(c) // 8 for c in batch.column(1).to_pylist()], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(batch.column(0).to_numpy(), sizes)), pa.array(np.frombuffer(join(1), np.int64)), pa.array(np.frombuffer(join(2), np.int32)),
                    pa.array(np.frombuffer(join(3), bool)), pa.array(np.repeat(sizes, sizes)),
                ],
                names=["set", "cid", "shared", "probes", "members"],
            )

    blobs = kept.join(lengths, "cid", "left").select("cid", "n", "shared", "frequency").mapInArrow(deal, BLOBS)
    met = blobs.groupBy("key").applyInArrow(meet, "set long, cids binary, shared binary, probes binary")
    return met.dropDuplicates(["set"]).mapInArrow(members, "set long, cid long, shared int, probes boolean, members long")


SKETCH = [f"s{i}" for i in range(8)]
WIDE = 400  # from so many shingles on, 512 bits rule little out


def sketches(kept: DataFrame) -> DataFrame:
    """cid, n, shared and 512 parity bits of the shared shingles: two sets differ by as many shingles, at least, as sketches by bits."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from siftwell.llm.shingles import mix

        for batch in batches:
            sets = [np.frombuffer(x, np.uint64) for x in batch.column(2).to_pylist()]
            bits = [np.bincount((mix(x) & np.uint64(511)).astype(np.int64), minlength=512) & 1 for x in sets]
            words = np.packbits(np.array(bits, dtype=np.uint8).reshape(len(sets), 512), axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(x) for x in sets], pa.int32()), *(pa.array(np.ascontiguousarray(words[:, i])) for i in range(8))],
                names=["cid", "n", "shared", *SKETCH],
            )

    return kept.select("cid", "n", "shared").mapInArrow(run, "cid long, n int, shared int, " + ", ".join(f"{c} long" for c in SKETCH))


def wide_sketches(kept: DataFrame) -> DataFrame:
    """cid, n, shared and parity words, a power of two of them with a bit for each shingle at least, of the sets from ``WIDE`` shingles on."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from siftwell.llm.shingles import mix

        for batch in batches:
            words = []
            for n, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                width = 1 << (n - 1).bit_length()
                bits = np.bincount((mix(np.frombuffer(x, np.uint64)) & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
                words.append(np.packbits(bits.astype(np.uint8)).view(np.int64))
            shared = pa.array([len(x) // 8 for x in batch.column(2).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), shared, pa.array(words, pa.list_(pa.int64()))], names=["cid", "n", "shared", "words"])

    long = kept.where(F.octet_length("shared") >= 8 * WIDE).select("cid", "n", "shared")
    return long.mapInArrow(run, "cid long, n int, shared int, words array<bigint>")


def wide_fits(pairs: DataFrame, wide: DataFrame) -> DataFrame:
    """The pairs (a, b, most) that wide sketches leave room for; a sketch of twice the width is folded to the other's. Others than long ones pass."""
    l, r = wide.alias("l"), wide.alias("r")
    fold = lambda x, y: F.when(F.size(x) > F.size(y), F.transform(F.slice(x, F.lit(1), F.size(y)), lambda w, i: w.bitwiseXOR(F.get(x, i + F.size(y))))).otherwise(x)
    x, y = F.col("l.words"), F.col("r.words")
    differ = F.aggregate(F.zip_with(fold(x, y), fold(y, x), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda sum_, v: sum_ + v)
    room = F.expr("l.shared + r.shared - 2 * cast(ceil(3 * (l.n + r.n) / 7) as int)")
    told = pairs.join(l, F.col("a") == F.col("l.cid"), "left").join(r, F.col("b") == F.col("r.cid"), "left")
    return told.where(F.col("l.cid").isNull() | F.col("r.cid").isNull() | (differ <= room)).select("a", "b", "most")


def may_link(a: str, b: str):
    """Sizes and sketches of two sets (aliases a and b) leave room for a link: no linked pair fails."""
    differ = " + ".join(f"bit_count({a}.{c} ^ {b}.{c})" for c in SKETCH)
    sizes = f"4 * least({a}.n, {b}.n) >= 3 * greatest({a}.n, {b}.n)"
    return F.expr(f"{sizes} and {differ} <= {a}.shared + {b}.shared - 2 * cast(ceil(3 * ({a}.n + {b}.n) / 7) as int)")


def likely_pairs(pairs: DataFrame, sketch: DataFrame) -> DataFrame:
    """The pairs (a, b) that sketches leave room for, with the larger number of shared shingles."""
    l, r = sketch.alias("l"), sketch.alias("r")
    met = pairs.join(l, F.col("a") == F.col("l.cid")).join(r, F.col("b") == F.col("r.cid")).where(may_link("l", "r"))
    return met.select("a", "b", F.greatest("l.shared", "r.shared").alias("most"))


def with_degrees(pairs: DataFrame) -> DataFrame:
    """Adds of_a and of_b: how many pairs each end has; stored."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).groupBy("node").agg(F.count("*").alias("degree"))
    of = lambda name: ends.select(F.col("node").alias(name), F.col("degree").alias(f"of_{name}"))
    return stored(pairs.join(of("a"), "a").join(of("b"), "b"), "degrees")


def best_pairs(pairs: DataFrame) -> DataFrame:
    """``pairs``: with degrees. Of each end the pair with the partner of most pairs: a forest that joins most of what links at all."""
    each = pairs.select(F.col("a").alias("node"), F.struct(F.col("of_b").alias("of"), F.col("b").alias("partner"), "most").alias("p"))
    each = each.union(pairs.select("b", F.struct("of_a", "a", "most")))
    best = each.groupBy("node").agg(F.max("p").alias("p"))
    return best.select(F.least("node", "p.partner").alias("a"), F.greatest("node", "p.partner").alias("b"), "p.most").distinct()


def verified(pairs: DataFrame, kept: DataFrame) -> DataFrame:
    """``pairs``: a, b, most. The pairs whose classes link by exact comparison; stored.

    Pairs are dealt to blocks by the end that has more of them, so that end travels to a block once for all its pairs. One with
    more pairs than a block holds has blocks of its own, each with so many of its partners; it travels to each of them, its partners to one.
    """
    placed = with_degrees(pairs)
    first = (F.col("of_a") > F.col("of_b")) | ((F.col("of_a") == F.col("of_b")) & (F.col("a") < F.col("b")))
    hub, partner = F.when(first, F.col("a")).otherwise(F.col("b")), F.when(first, F.col("b")).otherwise(F.col("a"))
    degree = F.greatest("of_a", "of_b")
    totals = placed.agg(F.count("*").alias("n"), F.sum("most").alias("values")).first()
    n_blocks = max(1, -(-totals["n"] // BLOCK), -(-(totals["values"] or 0) * 8 // BLOCK_BYTES))
    cut = F.ceil(F.greatest(degree / BLOCK, degree * F.col("most") * 8 / BLOCK_BYTES))
    own = F.xxhash64(F.lit(0), hub, F.pmod(F.xxhash64(partner), cut))
    dealt = stored(placed.select(F.when(cut > 1, own).otherwise(F.pmod(F.xxhash64(hub), F.lit(n_blocks))).alias("block"), "a", "b"), "blocks")
    needed = dealt.select(F.col("block").alias("home"), F.col("a").alias("cid")).union(dealt.select("block", "b")).distinct()
    sets = needed.join(kept, "cid").select("home", "cid", "n", "shared")

    def compare(asked, given):
        import numpy as np
        import pyarrow as pa

        known = {c: (n, np.frombuffer(x, np.uint64)) for c, n, x in zip(*(given.column(k).to_pylist() for k in ("cid", "n", "shared")))}
        ok = []
        for a, b in zip(asked.column("a").to_pylist(), asked.column("b").to_pylist()):
            (n, x), (m, y) = known[a], known[b]
            if len(x) > len(y):
                x, y = y, x
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            ok.append(7 * int((y[at] == x).sum()) >= 3 * (n + m))
        return asked.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    links = stored(dealt.groupBy("block").cogroup(sets.groupBy("home")).applyInArrow(compare, "a long, b long"), "links")
    discard(placed, dealt)
    return links


def _forest(batches: Iterator) -> Iterator:
    """The edges of each batch as stars around the smallest node of its own components: fewer edges, shorter ways."""
    import pyarrow as pa

    for batch in batches:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
        pairs = [(x, find(x)) for x in list(parent)]
        pairs = [p for p in pairs if p[0] != p[1]]
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) of every node of the links, by alternating large and small stars; stored."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    edges = stored(edges.mapInArrow(_forest, "u long, v long").distinct(), "edges")
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # of each node: its least neighbour, how many smaller ones it has, and whether it has larger ones
        ends = both.groupBy("u").agg(F.min("v").alias("m"), F.count_if(F.col("v") < F.col("u")).alias("lower"), F.bool_or(F.col("v") > F.col("u")).alias("upper"))
        ends = stored(ends, "ends")
        if ends.where("lower > 1 or lower = 1 and upper").isEmpty():
            break
        large = both.where("v > u").join(ends.select("u", F.least("u", "m").alias("m")), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v")))
        new = stored(small.distinct(), "edges")
        discard(edges, ends)
        edges = new
    out = stored(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct(), "roots")
    discard(edges, ends)
    return out


def candidate_pairs(sets: DataFrame, fitting=None) -> DataFrame:
    """a, b and most of each set: one probes, the other is indexed and has as many shared shingles or more (of equals, the larger id).

    ``fitting``: a further condition on the aliases p and i.
    """
    p, i = sets.where("probes").alias("p"), sets.where("not probes").alias("i")
    turn = (F.col("p.shared") < F.col("i.shared")) | ((F.col("p.shared") == F.col("i.shared")) & (F.col("p.cid") < F.col("i.cid")))
    met = p.join(i, (F.col("p.set") == F.col("i.set")) & turn & (F.lit(True) if fitting is None else fitting))
    return met.select(F.least("p.cid", "i.cid").alias("a"), F.greatest("p.cid", "i.cid").alias("b"), F.col("i.shared").alias("most"))


def linked_classes(kept: DataFrame) -> DataFrame:
    """node, root of every class that links with another; stored."""
    sets = stored(meeting_sets(kept), "sets")
    sketch = stored(sketches(kept), "sketches")
    few = candidate_pairs(sets.where(F.col("members") <= ALL_PAIRS))
    many = sets.where(F.col("members") > ALL_PAIRS)
    hubs = many.groupBy("set").agg(F.max(F.struct("shared", "cid")).alias("hub")).select("set", F.col("hub.cid").alias("hub"))
    stars = many.join(hubs, "set").where("cid <> hub").select(F.least("cid", "hub").alias("a"), F.greatest("cid", "hub").alias("b"))
    wide = stored(wide_sketches(kept), "wide")
    likely = _fitting(likely_pairs(few.select("a", "b").union(stars).distinct(), sketch), wide)
    ranked = with_degrees(likely)
    links = verified(best_pairs(ranked), kept)
    roots = components(links)
    discard(links, ranked)
    root_of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    apart = likely.join(root_of("a"), "a", "left").join(root_of("b"), "b", "left").where("coalesce(root_a, a) <> coalesce(root_b, b)").select("a", "b", "most")
    roots = _joined(roots, stored(apart, "apart"), kept)
    labelled = many.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    torn = labelled.groupBy("set").agg((F.min("root") != F.max("root")).alias("torn")).where("torn").select("set")
    open_sets = stored(labelled.join(torn, "set", "left_semi").select("set", "cid", "probes", "root").join(sketch, "cid"), "open")
    cross = candidate_pairs(open_sets, (F.col("p.root") != F.col("i.root")) & may_link("p", "i")).groupBy("a", "b").agg(F.max("most").alias("most"))
    out = _joined(roots, _fitting(cross, wide), kept)
    discard(sets, sketch, wide, likely, open_sets)
    return out


def _fitting(pairs: DataFrame, wide: DataFrame) -> DataFrame:
    """Pairs of long sets after the test by wide sketches, with all others; stored."""
    met = stored(pairs, "met")
    out = stored(wide_fits(met.where(F.col("most") >= WIDE), wide).union(met.where(F.col("most") < WIDE)), "fitting")
    discard(met)
    return out


def _joined(roots: DataFrame, pairs: DataFrame, kept: DataFrame) -> DataFrame:
    """``roots`` after the links among ``pairs``; both are stored and are removed."""
    if pairs.isEmpty():
        discard(pairs)
        return roots
    links = verified(pairs, kept)
    out = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(links))
    discard(roots, pairs, links)
    return out


def named_classes(rows: DataFrame, df: DataFrame, text_col: str) -> DataFrame:
    """cid, component_id and winner (id and cid of the row that stands for the component) of every class with shingles."""
    total = rows.agg(F.sum("n")).first()[0] or 0
    classes = rows.where("n > 0").groupBy("cid").agg(F.min("id").alias("rep"))
    if not total:
        return classes.select("cid", F.col("rep").alias("component_id"), F.struct(F.col("rep").isNull().alias("no_id"), F.col("rep").alias("id"), "cid").alias("winner"))
    kept = stored(shared_shingles(df, text_col, total), "kept")
    roots = linked_classes(kept)
    discard(kept)
    reps = classes.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    first = F.struct(F.col("rep").isNull().alias("no_id"), F.col("rep").alias("id"), F.col("cid"))
    lowest = reps.groupBy("root").agg(F.min("rep").alias("component_id"), F.min(first).alias("winner"))
    return reps.join(lowest, "root").select("cid", "component_id", "winner")


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, cid and component_id: the smallest id that links reach, the row's own included."""
    rows = stored(row_classes(df, id_col, text_col), "classes")
    named = named_classes(rows, df, text_col).select("cid", "component_id")
    out = rows.join(named, "cid", "left").withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "cid", "component_id")


def keep_one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of every component: that of the smallest id, null ids last. Rows without words link with nothing and all stay.

    Where rows share that id, one of the class with the smaller number stays, of equal sets the first by text, then by the other columns.
    A row that shares its id with a linked one but links with nothing itself stays.
    """
    rows = stored(row_classes(df, id_col, text_col), "classes")
    chosen = named_classes(rows, df, text_col).select("winner.id", "winner.cid").distinct()
    chosen = stored(chosen.select(F.coalesce("id", F.lit(0)).alias("_key"), F.col("id").isNull().alias("_none"), F.col("cid").alias("_cid")), "chosen")
    discard(rows)
    numbered, names = numbered_columns(df)
    marked = with_classes(numbered, names[text_col])
    one = F.col(names[id_col]).cast("long")
    keyed = marked.withColumns({"_key": F.coalesce(one, F.lit(0)), "_none": one.isNull()})
    spread = F.when(F.col("_n") == 0, F.xxhash64(*names.values())).otherwise(F.col("_cid"))  # rows without words are no group
    keyed = keyed.withColumn("_cid", spread)
    found = keyed.join(chosen.withColumn("_chosen", F.lit(True)), ["_key", "_none", "_cid"], "left").where("_chosen or _n = 0")
    order = W.partitionBy("_key", "_none", "_cid").orderBy(names[text_col], F.xxhash64(*names.values()))
    return named_again(found.withColumn("_rank", F.row_number().over(order)).where("_rank = 1 or _n = 0"), names)


def with_classes(df: DataFrame, text_col: str) -> DataFrame:
    """``df`` with _n (distinct shingles) and _cid of each row."""
    at = df.columns.index(text_col)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from siftwell.llm.shared import text_slices
        from siftwell.llm.shingles import of_arrow

        for whole in batches:
            for batch in text_slices(whole, at, SLICE):
                sets = of_arrow(batch.column(at))
                made = [pa.array([len(s) for s in sets], pa.int64()), pa.array([_class_id(s) for s in sets], pa.int64())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "_n", "_cid"])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField("_n", LongType()), StructField("_cid", LongType())]))
