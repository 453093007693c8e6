import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.llm import jaccard, shingles


def words_of(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def shingle_set(text):
    w = words_of(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def brute(rows):
    """rows: (id, text). id -> (set size, component), by all pairs that share a shingle."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    by = {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    tested = set()
    for members in by.values():
        for i in range(len(members)):
            for j in range(i):
                pair = (members[j], members[i])
                if pair not in tested:
                    tested.add(pair)
                    a, b = sets[pair[0]], sets[pair[1]]
                    if 100 * len(a & b) >= 75 * len(a | b):
                        parent[find(pair[0])] = find(pair[1])
    low = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            low[find(i)] = min(low.get(find(i), doc), doc)
    return sorted(((doc, len(s), low.get(find(i)) if s else doc) for i, ((doc, _), s) in enumerate(zip(rows, sets))), key=str)


def edited(rng, words, share):
    out = list(words)
    for _ in range(max(1, int(len(out) * share))):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return out


def made(seed):
    rng = random.Random(seed)
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "a b c d"), (8, "a b c d e"), (9, "A b  c\td e"), (None, "a b c d e"), (None, "lost"), (8, "a b c d e")]
    common = [f"c{i}" for i in range(60)]
    doc = 10
    for size in [6, 8, 12, 20, 35, 60, 100, 180, 300, 700]:
        base = [f"w{rng.randrange(5000)}" for _ in range(size)]
        for _ in range(rng.randrange(2, 7)):
            copy = edited(rng, base, rng.choice([0.01, 0.02, 0.03, 0.05]))
            copy = copy[: len(copy) - rng.randrange(0, max(1, size // 5))]
            if rng.random() < 0.3:
                copy = copy + common
            rows.append((doc, " ".join(copy)))
            doc += 1
        base = copy if rng.random() < 0.5 else base
    for _ in range(60):
        rows.append((doc, " ".join(common + [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(80))])))
        doc += 1
    base = [f"h{i}" for i in range(120)]
    for _ in range(60):  # a large group of near copies, not all of which link directly
        rows.append((doc, " ".join(edited(rng, base, 0.02))))
        doc += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_a_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(jaccard, "BUCKET", 3000)
    monkeypatch.setattr(jaccard, "SLICE", 20_000)
    rows = made(seed)
    df = spark.createDataFrame([(*r, "clash", 0) for r in rows], "doc_id long, text string, component_id string, n long").repartition(3)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect()), key=str)
    assert got == brute(rows)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()), key=str)
    assert got == brute(rows)
    kept = jaccard.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted({c for _, _, c in got})


def test_rows_that_share_an_id_are_kept_apart(spark):
    a, b = "one two three four five six seven", "other words that link with nothing at all here"
    rows = [(1, a, "x"), (8, a, "x"), (8, b, "x"), (8, b, "y"), (None, a, "x"), (None, "text of rows without any id", "x"), (9, "text of rows without  any ID", "x"), (None, "lost row of six words here", "x"), (None, "lost row of six words here", "z")]
    rows += [(3, None, "x"), (3, None, "x"), (None, "", "x"), (5, "short", "x"), (5, "SHORT", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _cid string").repartition(3)
    got = sorted(((r.doc_id, r.text, r._cid) for r in jaccard.keep_one_of_each(df).collect()), key=str)
    want = [(1, a, "x"), (8, b, "x"), (9, "text of rows without  any ID", "x"), (None, "lost row of six words here", "x"), (3, None, "x"), (3, None, "x"), (None, "", "x"), (5, "SHORT", "x")]
    assert {r[:2] for r in got} == {r[:2] for r in want} and len(got) == len(want)


def test_one_bucket_keeps_all_bits_of_a_shingle(spark):
    import pyarrow as pa

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    texts = [r.text for r in docs.collect()]
    whole = {jaccard._class_id(s): s for s in shingles.of_arrow(pa.array(texts))}
    times = np.unique(np.concatenate(list(whole.values())), return_counts=True)
    shared = set(times[0][times[1] > 1].tolist())
    found = jaccard.shared_shingles(docs, "text", 1).collect()
    want = {c for c, s in whole.items() if len(s) and 4 * len(shared & set(s.tolist())) >= 3 * len(s)}
    assert {r.cid for r in found} == want and found
    for r in found:
        assert set(np.frombuffer(r.shared, np.uint64).tolist()) == shared & set(whole[r.cid].tolist())


def test_a_large_group_is_compared_in_blocks(spark, monkeypatch):
    """3,000 near copies, most of which do not link with each other but with the common text, in blocks of 100."""
    monkeypatch.setattr(jaccard, "BLOCK", 100)
    rng = random.Random(12)
    base = [f"h{i}" for i in range(100)]
    rows = [(0, " ".join(base))]
    for i in range(1, 3000):
        out = list(base)
        for at in rng.sample(range(10, 90), 2):
            out[at] = f"e{rng.randrange(40)}"
        rows.append((i, " ".join(out)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect()), key=str)
    sets = {i: shingle_set(t) for i, t in rows}
    assert [g[:2] for g in got] == sorted(((i, len(s)) for i, s in sets.items()), key=str)
    direct = {i for i, s in sets.items() if 100 * len(s & sets[0]) >= 75 * len(s | sets[0])}
    assert {g[0] for g in got if g[2] == 0} >= direct and len(direct) > 2500


def test_tables_without_words(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect()) == [(1, 0, 1), (2, 0, 2)]
    assert jaccard.jaccard_components(df.limit(0)).count() == 0
    assert jaccard.keep_one_of_each(df.limit(0)).count() == 0


def test_shingles_of_batches():
    rng = random.Random(4)
    texts = ["".join(rng.choice("aB é\n\t.x") for _ in range(rng.randrange(60))) for _ in range(200)] + ["", "word " * 50000]
    import pyarrow as pa

    sets = shingles.of_arrow(pa.array([None, *texts]))
    assert not len(sets[0])
    names = {}
    for t, s in zip(texts, sets[1:]):
        want = shingle_set(t)
        assert len(want) == len(s)
        one = shingles.of_arrow(pa.array([t]))[0]
        assert np.array_equal(one, s)
        assert names.setdefault(want, s.tobytes()) == s.tobytes()
    sliced = pa.array(["skip this one please now", *texts])[1:]
    assert all(np.array_equal(a, b) for a, b in zip(shingles.of_arrow(sliced), sets[1:]))


def test_pigeonhole_holds_for_linked_sets():
    rng = np.random.default_rng(8)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        base = rng.integers(0, 1 << 60, n, dtype=np.uint64)
        x = np.unique(base)
        y = np.unique(np.concatenate([base[rng.random(n) > 0.1], rng.integers(0, 1 << 60, max(1, n // 15), dtype=np.uint64)]))
        both = len(np.intersect1d(x, y))
        if not len(y) or 7 * both < 3 * (len(x) + len(y)):
            continue
        # shingles that only one of the two has may be missing from the shared ones
        own = np.setdiff1d(x, y)
        xs = np.setdiff1d(x, own[: len(own) // 2]) if rng.random() < 0.5 else x
        ys = np.setdiff1d(y, np.setdiff1d(y, x)) if rng.random() < 0.5 else y
        starts = jaccard.band_starts(1000)
        (few, n), (more, m) = sorted(((xs, len(x)), (ys, len(y))), key=lambda p: len(p[0]))
        lists = rng.integers(0, 1000, 5000)
        index, probes = jaccard.index_entries(m, more, starts), jaccard.probe_entries(n, few, starts, lists)
        met = set()
        for a, b in ((jaccard.EXACT, 0), (jaccard.NEAR, 0), (jaccard.SHORTER, 0), (jaccard.NEAR, jaccard.NEIGHBOUR)):
            met |= set((probes[probes & np.uint64(7) == a] >> np.uint64(3)).tolist()) & set((index[index & np.uint64(7) == b] >> np.uint64(3)).tolist())
        assert met


def test_allocation_adds_up():
    rng = np.random.default_rng(3)
    for _ in range(100):
        m = int(rng.integers(1, 50))
        need = int(rng.integers(1, 2 * m + 1))
        a = jaccard.allocate(rng.integers(0, 100, m), rng.integers(0, 6, m), need)
        assert (a + 1).sum() == need and a.min() >= -1 and a.max() <= 1
    for n in range(1, 3000):
        starts = jaccard.band_starts(n)
        starts.append(starts[-1] * 4 // 3 + 1)
        for k, need in jaccard.probed_bands(n, n, starts):
            assert need <= 2 * jaccard.segments_of(starts[k], starts[k + 1] - 1)


def test_components_of_chains(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n) if i % 50] + [(5, 5), (400, 300)], "a long, b long")
    got = {r.node: r.root for r in jaccard.components(edges).collect()}
    for i in range(1, n):
        assert got[i] == (i // 50 * 50 + 1 if i % 50 else i - 49), i
    assert got[400] == got[300]
    assert jaccard.components(edges.limit(0)).count() == 0
    assert F is not None


def test_dealing_a_batch_takes_no_more_time_for_more_buckets():
    import time

    import numpy as np

    rng = np.random.default_rng(1)
    found = [rng.integers(0, 1 << 63, 200, dtype=np.uint64) for _ in range(50)]
    cids, extra = np.arange(50), np.zeros(50, dtype=np.int32)
    took = []
    for n_buckets in (20_000, 50_000_000):
        began = time.process_time()
        rows = jaccard._dealt(found, cids, extra, n_buckets)
        took.append(time.process_time() - began)
        assert sum(np.frombuffer(r[3], np.int32).sum() for r in rows) == 10_000 and [r[0] for r in rows] == sorted({r[0] for r in rows})
    assert took[1] < 10 * max(took[0], 0.05)
