import re

import pytest
from pyspark.sql import Row

from siftwell.llm import mixing, sharding

SCHEMA = "doc_id long, text string, lang string, source string, size string, shard string"


def docs(spark):
    rows = [(i, "w " * (i % 37), "en", "hot" if i % 3 == 0 else f"s{i % 7}", "x", "y") for i in range(900)]
    rows += [(900, None, None, None, None, None), (901, "", "en", None, None, None), (902, "a  b\tc\n", None, None, None, None), (902, "a  b\tc\n", None, None, None, None)]
    rows += [(903, "one", "en", "tiny", None, None), (None, "lost id", "en", "tiny", None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def brute_targets(sizes: dict, cap=3):
    order = sorted(sizes, key=lambda s: (s is None, s))
    weights = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(cap * sizes[s] for s in capped)
        share = {s: left * weights[s] / sum(weights[f] for f in free) for s in free}
        over = {s for s in free if share[s] > cap * sizes[s]}
        if not over:
            return weights, {s: float(cap * sizes[s]) if s in capped else share[s] for s in order}
        capped |= over


def test_targets_and_copies_follow_a_brute_force(spark):
    df = docs(spark)
    got = mixing.mix_plan(df).collect()
    sizes, largest = {}, {}
    for r in df.collect():
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        sizes[r.source] = sizes.get(r.source, 0) + n
        largest[r.source] = max(largest.get(r.source, 0), n)
    weights, targets = brute_targets(sizes)
    assert len(got) == df.count()
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and r.weight == weights[r.source]
        assert r.target == pytest.approx(targets[r.source])
        assert r.taken == r.copies * r["size"] <= 3 * r["size"] and len(r.positions) == r.copies
        assert all(0 <= p <= 1 for p in r.positions) and r.positions == sorted(r.positions)
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= largest[s]
    again = mixing.mix_plan(df.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_targets_of_many_sources_by_parts(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SOURCES", 20)
    sizes = {f"s{i:03d}": (i * 37) % 101 * (1 if i % 9 else 40) for i in range(150)} | {"t": 10**6}
    df = spark.createDataFrame([(f"0{k}", v) for k, v in sizes.items()], "_group string, source_size long")
    weights, targets = brute_targets(sizes)
    got = {r._group[1:]: (r.weight, r.target) for r in mixing.source_targets(df).collect()}
    assert {k: v[0] for k, v in got.items()} == weights
    assert all(got[k][1] == pytest.approx(targets[k]) for k in sizes)


def test_columns_of_any_name_rows_of_equal_ids_and_long_texts(spark):
    rows = [(1, "a b", "s", 0.5), (1, "c d", "s", 0.5), (1, "c d", "s", 0.5), (None, None, None, None), (2, "long word " * 200_000, "t", None), (3, "x", None, 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _position double")
    plan = mixing.mix_plan(df)
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    count = lambda frame, n: sorted((r.doc_id, n(r)) for r in frame.collect() if r.doc_id is not None)
    times = {}
    for r in plan.collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + r.copies
    got = {}
    for r in mixed.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {k: v for k, v in times.items() if v} and count(df, lambda r: len(r.text or ""))[-2][1] == 2_000_000


def test_inverse_of_the_schedule(spark):
    for levels in mixing.SCHEDULES + ((0.0, 2.0, 0.0),):
        s = mixing.Schedule(mixing.KNOTS, levels)
        for share in (0.0, 0.1, 0.5, 0.77, 1.0):
            from pyspark.sql import functions as F

            t = spark.range(1).select(s.inverse(F.lit(share)).alias("t")).first().t
            area, n = 0.0, 20000
            for i in range(int(t * n)):
                x = (i + 0.5) / n
                k = 0 if x < 0.5 else 1
                area += (levels[k] + (levels[k + 1] - levels[k]) * (x - 0.5 * k) / 0.5) / n
            assert area / s.integral()[-1] == pytest.approx(share, abs=1e-3)


def test_mix_returns_the_columns_of_documents_and_empty_tables_stay_empty(spark):
    df = docs(spark)
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    assert mixed.count() == sum(r.copies for r in mixing.mix_plan(df).collect())
    assert mixing.mix(df.limit(0)).count() == 0
    assert mixing.range_sorted(mixing.mix_plan(df.limit(0))).count() == 0


def test_shards_hold_the_mixture(spark):
    df = docs(spark)
    got = sharding.interleaved_shards(df, 16).collect()
    n = df.count()
    assert len(got) == n and sorted(r.position for r in got) == list(range(n))
    by_shard = {}
    for r in got:
        by_shard.setdefault(r.shard, []).append(r)
    counts = [len(v) for v in by_shard.values()]
    assert len(by_shard) == 16 and max(counts) - min(counts) <= 1
    for rows in by_shard.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
        assert abs(sum(r.source == "hot" for r in rows) - 300 / 16) <= 2
    null = next(r for r in got if r.doc_id == 900)
    assert null["size"] == 1 and null.text_crc32 == 0
    assert sorted(map(str, sharding.interleaved_shards(df.repartition(5), 16).collect())) == sorted(map(str, got))
    assert sharding.interleaved_shards(df.limit(0), 16).count() == 0


def test_ranks_of_shards_against_a_brute_force(spark):
    from pyspark.sql import functions as F

    df = docs(spark)
    keyed = df.select("doc_id", "source", F.coalesce("text", F.lit("")).alias("t")).select("doc_id", "source", (F.octet_length("t") + 1).cast("long").alias("size"), F.crc32(F.col("t").cast("binary")).alias("crc"))
    rows = [tuple(r) for r in keyed.withColumn("h", F.xxhash64(F.lit(42), "doc_id", "crc", "size")).collect()]
    order = lambda r: (r[4], r[0] is not None, r[0] or 0, r[2], r[3])
    ranked = []
    for source in {r[1] for r in rows}:
        mine = sorted((r for r in rows if r[1] == source), key=order)
        ranked += [((i + 0.5) / len(mine), source is None, source or "", order(r), r[0]) for i, r in enumerate(mine)]
    want = [r[4] for r in sorted(ranked)]
    got = [r.doc_id for r in sharding.interleaved_shards(df, 16).orderBy("position").collect()]
    assert got == want
    cut = len(want)
    shards = [r.shard for r in sharding.interleaved_shards(df, 16).orderBy("position").collect()]
    assert shards == [i * 16 // cut for i in range(cut)]


def test_more_shards_than_rows(spark):
    df = spark.createDataFrame([(i, "t", "en", "s", None, None) for i in range(3)], SCHEMA)
    assert sorted((r.shard, r.slot) for r in sharding.interleaved_shards(df, 16).collect()) == [(0, 0), (5, 0), (10, 0)]


def test_shards_are_written_whole(spark, tmp_path):
    df = docs(spark).where("doc_id is not null").dropDuplicates(["doc_id"]).drop("shard")
    placed = sharding.interleaved_shards(df, 4)
    sharding.write_shards(df, placed, f"file://{tmp_path}/out")
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == df.count()
    assert isinstance(placed.first(), Row)
