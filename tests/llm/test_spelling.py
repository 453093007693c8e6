"""Spelling variants against brute force; the bound of touched grams against all edits."""

import random
import re
import zlib
from collections import Counter

import pytest

from siftwell.llm import queries, spelling


def edits(word, letters):
    out = {word[:i] + word[i + 1 :] for i in range(len(word))}
    out |= {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in letters}
    out |= {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters}
    return out - {word}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a != b and (a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :])


def brute_words(rows):
    total = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if n >= 2 and len(w) >= 7}


def brute(rows):
    words = brute_words(rows)
    letters = sorted({c for w in words for c in w})
    long = [w for w in words if len(w) > 500]
    near = {w: [v for v in long if one_edit(w, v)] if w in long else [v for v in edits(w, letters) if v in words] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (w, form[w], root, n, len(near[w]), words.get(form[w]))
    return out


def query(spark, path, rows):
    spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, word string, n int").write.parquet(f"{path}/documents.parquet")
    got = queries.op11_spelling_variants(spark, path).collect()
    found = {r.word: (r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got}
    assert len(found) == len(got)
    return found


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(4)
    stems = ["nation", "station", "organise", "colour", "straße", "garçonnet", "ÀÇÉñandú", "aaaaaaa", "abababab", "internationalisation"]
    base = ["".join(rng.sample(stems, 2)) for _ in range(25)] + ["aaaaaaaa", "aaaaaaa", "ababababa", "babababa", "x" * 3000]
    words = []
    for w in base:
        words += [w] * rng.choice([2, 3, 30, 400])
        for v in rng.sample(sorted(edits(w, "abcé×")), 12) if len(w) < 500 else [w[1:], w[1:] + "a"]:
            words += [v] * rng.choice([1, 2, 2, 4])
    rng.shuffle(words)
    rows = [(i if i != 5 else None, " ".join(words[i::60]).replace("a", rng.choice("aA"), 3)) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "1234 -- 日本語"), rows[0], (103, "y" * 20000 + " " + "y" * 20000 + " " + "y" * 19999 + " " + "y" * 19999)]
    assert query(spark, f"file://{tmp_path}/a", rows) == brute(rows)
    assert query(spark, f"file://{tmp_path}/b", []) == {}


def test_query_on_the_smallest_tables(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.word: (r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in queries.op11_spelling_variants(spark, sf).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("q_max", [3, 4, 6])
def test_bound_holds_for_every_edit(q_max):
    """Every gram outside the bound is in the other word, left of the edit at the same begin or right of it at the same distance from the end."""
    rng = random.Random(q_max)
    pool = ["".join(rng.choice("abc") for _ in range(rng.randrange(7, 14))) for _ in range(120)]
    grams = Counter(w[i : i + q] for w in pool for q in range(3, q_max + 1) for i in range(len(w) - q + 1))
    index = spelling.GramIndex({g: n for g, n in grams.items() if rng.random() < 0.4}, q_max)
    for word in pool[:40]:
        own = index.decompose(word)
        bound = index.bound(word, own)
        assert q_max > 3 or bound < len(own)
        for other in edits(word, "abcd"):
            theirs = {(other[b:e], b) for b, e in index.decompose(other)}
            moved = len(other) - len(word)
            same = next((i for i, (x, y) in enumerate(zip(word, other)) if x != y), min(len(word), len(other)))
            shared = sum((word[b:e], b) in theirs if e <= same else (word[b:e], b + moved) in theirs for b, e in own)
            assert shared >= len(own) - bound, (word, other)


def test_any_dictionary_gives_the_same_links(spark):
    rng = random.Random(9)
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randrange(7, 11))) for _ in range(1500)})
    df = spark.createDataFrame([(w, 2) for w in words], "word string, n int")
    known = set(words)
    want = {tuple(sorted((w, v))) for w in words for v in edits(w, "abcd") if v in known}
    for q_max, max_grams in ((6, 100_000), (6, 50), (3, 100_000), (4, 0)):
        got = spelling.near_words(df, q_max, max_grams).collect()
        assert len(got) == len(want) and {tuple(sorted((r.a, r.b))) for r in got} == want


def test_words_lose_nothing_without_a_hash(spark):
    df = spark.createDataFrame([(1, "Colours colours COLOURS short"), (2, None)], "doc_id long, text string")
    assert [(r.word, r.n) for r in spelling.count_words(df, every=0).collect()] == [("colours", 3)]
