import hashlib
import random

from pyspark.sql import functions as F

from siftwell.llm import queries, syncmers

rng = random.Random(2)
WORDS = ["alpha", "bet", "c", "delta", "épsilon", "zeta", "eta", "θ", "iota", "k"]
LONG = " ".join(f"w{rng.randrange(10**6)}" for _ in range(5000))
TEXTS = [None, "", " ", "one", "one two three", LONG, LONG[:20000], "\n".join(rng.choice(WORDS) for _ in range(100)), "x" * 9999, "a " * 500, LONG, "😀 " * 20, "p q r s t u v w x y z a b c d e f g h", "日本語の文章です。これは試験です。" * 3 + "ไทย x"]


def frame(spark, texts=TEXTS):
    rows = [(i if i != 4 else None, t, "clash", "clash") for i, t in enumerate(texts)] + [(7, texts[7], None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, anchors string, fingerprint string")


def hashes(spark, words):
    """xxhash64 of words, pairs and k-mers comes from the engine; the choice of anchors is checked apart."""
    return [r[0] for r in spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string").orderBy("i").select(F.xxhash64("w")).collect()]


UNSPACED = [(0xE00, 0xEFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FA1F), (0x30000, 0x3134F)]


def brute_tokens(text):
    out, word = [], ""
    for c in (text or "") + " ":
        alone = any(a <= ord(c) <= b for a, b in UNSPACED)
        if word and (alone or c in " \t\n\x0b\x0c\r" or len(word) == 32):
            out.append(word)
            word = ""
        if alone:
            out.append(c)
        elif c not in " \t\n\x0b\x0c\r":
            word += c
    return out


def brute_anchors(spark, text):
    words = brute_tokens(text)
    if not words:
        return []
    pad = [0] * (syncmers.K - 1)
    h = pad + hashes(spark, words) + pad
    pairs = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(h, h[1:]))], "i int, a long, b long")
    m = [r[0] for r in pairs.orderBy("i").select(F.xxhash64("a", "b")).collect()]
    width = syncmers.K - syncmers.S + 1
    picked = []
    for i in range(len(m) - width + 1):
        window = m[i : i + width]
        if min(window) in (window[0], window[-1]):
            picked.append(tuple(h[i : i + syncmers.K]))
    names = [f"c{j}" for j in range(syncmers.K)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(picked)], "i int, " + ", ".join(f"{n} long" for n in names))
    return [r[0] for r in df.orderBy("i").select(F.shiftright(F.xxhash64(*names), 32).cast("int")).collect()]


def test_anchors_against_a_brute_force(spark):
    got = {r.doc_id: r.anchors for r in syncmers.fingerprints(frame(spark)).collect()}
    for i in (0, 1, 2, 3, 5, 7, 8, 9, 12, 13):
        assert got[i] == brute_anchors(spark, TEXTS[i]), i
    assert got[5] == got[10] and len(got[9]) >= 1
    assert syncmers.fingerprints(frame(spark).limit(0)).count() == 0


def test_next_row_over_parts(spark):
    rows = [(i, f"t{i}") for i in range(1, 500, 3)] + [(None, "null a"), (None, "null b"), (100, "same"), (100, "same"), (1_000_000, "far")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = sorted(zip(order, [r[1] for r in order[1:] + order[:1]]), key=str)
    for per_part in (7, 50, 10_000):
        got = [((r.doc_id, r.text), r.next_text) for r in syncmers.with_next(df, "doc_id", {"text": F.col("text")}, per_part).collect()]
        assert sorted(got, key=str) == want
    one = df.where("doc_id = 1000000")
    assert syncmers.with_next(one, "doc_id", {"text": F.col("text")}).first().next_text == "far"
    assert syncmers.with_next(df.limit(0), "doc_id", {"text": F.col("text")}).count() == 0


def test_query_against_texts_edited_in_python(spark, tmp_path):
    path = f"file://{tmp_path}/sf"
    frame(spark).write.parquet(f"{path}/documents.parquet")
    got = queries.op6_fingerprints(spark, path).collect()
    rows = sorted([(i if i != 4 else None, t or "") for i, t in enumerate(TEXTS)] + [(7, TEXTS[7])], key=lambda r: (r[0] is None, -(r[0] or 0)))
    want = {}
    for (i, t), (_, n) in zip(rows, rows[1:] + rows[:1]):
        half = len(t) // 2
        want.setdefault(i, []).append((len(t), hashlib.sha256((t[: len(t) - half] + n[:half]).encode()).hexdigest()))
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_chars, r.edited_sha256) in want[r.doc_id]
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert len(r.fingerprint) % 8 == 0
    by = {r.doc_id: r for r in got}
    assert by[5].fingerprint == by[10].fingerprint and by[0].fingerprint == ""
    assert by[5].near_edited > 0.4 > by[5].near_next


def test_edits_keep_half_of_the_anchors(spark):
    docs = queries.op6_fingerprints(spark, "/root/testdata/sf0.001").where("n_chars > 400")
    means = docs.agg(F.avg("near_edited"), F.avg("near_next")).first()
    assert means[0] > 0.4 and means[1] < 0.2


def test_one_kind_of_anchors_for_all_sizes(spark):
    words = [f"w{i}" for i in range(16)]
    kana = "".join(chr(0x3041 + (i * 7) % 80) for i in range(390))
    pairs = [(" ".join(words), " ".join(words[:15])), (" ".join(words[:9]), " ".join(words[:8])), (kana, kana[:300] + kana[:90]), ("one", "one"), ("one", "two"), ("x" * 2000, "x" * 1000 + "y" * 1000)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, s string, t string")
    near = [r[0] for r in df.orderBy("i").select(syncmers.likeness(syncmers.placed_anchors(F.col("s")), syncmers.placed_anchors(F.col("t")))).collect()]
    assert near[0] > 0.6 and near[1] > 0.4 and near[2] > 0.6 and near[3] == 1.0 and near[4] == 0.0 and 0.4 < near[5] < 0.6


def test_halves_of_all_documents(spark):
    rows = queries.op6_fingerprints(spark, "/root/testdata/sf0.001").collect()
    half = [r.near_edited for r in rows if r.n_chars > 60]
    assert min(half) > 0.15 and abs(sum(half) / len(half) - 0.5) < 0.1


def test_the_plan_does_not_grow_with_the_rows(spark):
    plan = lambda n: len(syncmers.with_next(spark.range(n).withColumn("t", F.lit("x")), "id", {"t": F.col("t")}, 10)._jdf.queryExecution().optimizedPlan().toString())
    assert plan(5000) < 1.2 * plan(500)


def brute_likeness(a, b):
    """(hash, position) lists: n-th occurrences are matched; the largest group of equal difference counts."""
    def numbered(x):
        seen, out = {}, {}
        for h, at in x:
            seen[h] = seen.get(h, 0) + 1
            out[h, seen[h]] = at
        return out

    if not a and not b:
        return 1.0
    na, nb = numbered(a), numbered(b)
    groups = {}
    for k in set(na) & set(nb):
        groups[nb[k] - na[k]] = groups.get(nb[k] - na[k], 0) + 1
    return max(groups.values(), default=0) / max(len(a), len(b))


def test_likeness_depends_on_positions_and_repeats(spark):
    words = LONG.split()[:900]
    turned = " ".join(words[600:] + words[300:600] + words[:300])
    texts = [t or "" for t in TEXTS[:5] + TEXTS[7:10] + TEXTS[11:]] + [" ".join(words), turned, " ".join(words[:400]), "new " * 3 + " ".join(words), "a " * 17, "b a " * 40, "a b c a", "c a b a"]
    rows = [(i, j, s, t) for i, s in enumerate(texts) for j, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "i int, j int, s string, t string").select("i", "j", syncmers.placed_anchors(F.col("s")).alias("a"), syncmers.placed_anchors(F.col("t")).alias("b"))
    got = {(r.i, r.j): r for r in df.withColumn("near", syncmers.likeness(F.col("a"), F.col("b"))).collect()}
    split = lambda x: [(v >> 32, v & 0xFFFFFFFF) for v in x]
    for r in got.values():
        assert abs(r.near - brute_likeness(split(r.a), split(r.b))) < 1e-12, (r.i, r.j)
    at = {t: i for i, t in enumerate(texts)}
    near = lambda s, t: got[at[s], at[t]].near
    whole = " ".join(words)
    assert near(whole, whole) == 1.0 and near(whole, turned) < 0.4 and near(whole, "new " * 3 + whole) > 0.95
    assert near("a " * 500, "a " * 17) < 0.05 and near("a b c a", "c a b a") < 1.0
