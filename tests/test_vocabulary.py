"""Vocabularies and run-together words over small tables."""

from siftwell.operators import mining
from siftwell.plans import catalog


def write(spark, path, texts, passages=()):
    spark.createDataFrame([(i, t, "en", source, len(t)) for i, (source, t) in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(passages)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_domain_words_of_any_frequency_british_and_two_edits(spark, tmp_path):
    path = f"file://{tmp_path}/sf"
    texts = [(f"s{i % 3}", f"{'behavioral ' * 20}suboxone{' colour' * (i == 1)}{' bahaviorla' * (i == 2)} filler{'abcdefghij'[i % 10]}") for i in range(40)]
    write(spark, path, texts, ["behavioral color filler"])
    got = {r.token: r for r in catalog.a22_domain_vocabulary(spark, path).collect()}
    assert (got["suboxone"]["class"], got["suboxone"].freq, got["suboxone"].brands) == ("vocab", 40, 3)
    assert (got["colour"]["class"], got["colour"].correct) == ("british", "color")
    assert (got["bahaviorla"]["class"], got["bahaviorla"].correct) == ("typo", "behavioral")
    assert "behavioral" not in got


def test_pairs_of_two_edits_against_a_brute_force(spark):
    def edits(w):
        cuts = [(w[:i], w[i:]) for i in range(len(w) + 1)]
        out = {a + b[1:] for a, b in cuts if b} | {a + b[1] + b[0] + b[2:] for a, b in cuts if len(b) > 1}
        return out | {a + c + b[1:] for a, b in cuts if b for c in "abcd"} | {a + c + b for a, b in cuts for c in "abcd"}

    rare = ["abcd", "abdc", "aabb", "dcba", "abcdabcd", "bacd", "cab"]
    common = ["abcd", "abc", "badc", "abba", "abcdbacd", "bcda", "acbd", "dddd"]
    want = {(r, c) for r in rare for c in common if r != c and c in edits(r) | {y for x in edits(r) for y in edits(x)}}
    frame = lambda x: spark.createDataFrame([(w,) for w in x], "token string")
    assert {(r.rare, r.common) for r in mining.fuzzy_pairs_two(frame(rare), frame(common)).collect()} == want


def test_run_together_has_long_parts_and_long_real_words(spark, tmp_path):
    path = f"file://{tmp_path}/sf"
    line = "best rehab centers california treatment the"
    rare = ["bestrehabcalifornia", "treatmentcenterscalifornia", "xqbestrehabcentersyz", "californiaxxxxxxxxxxxxtreatment", "bestrehabthexq"]
    texts = [("s", line) for _ in range(120)] + [("s", "besttreatmentcenters") for _ in range(6)] + [("s", w) for w in rare]
    write(spark, path, texts)
    words = line.split()

    def brute(w):
        best = {0: (0, 0)}  # end: letters covered, parts, without a gap from the start
        for end in range(1, len(w) + 1):
            fits = [(best[end - len(p)][0] + len(p), best[end - len(p)][1] + 1) for p in words if w[:end].endswith(p) and end - len(p) in best]
            if fits:
                best[end] = max(fits)
        ends = [best[e] for e in best if e >= len(w) - 4]
        return len(w) >= 16 and any(c >= 0.8 * len(w) and n >= 3 for c, n in ends)

    got = {r.token for r in catalog.r9_run_together(spark, path).collect()}
    assert got == {w for w in rare if brute(w)} == {"bestrehabcalifornia", "treatmentcenterscalifornia"}


def test_vocabulary_findings_names_endings_compounds_and_slugs(spark):
    rows = [
        ("https://h.com/a/treatmant-center/", "acme", "Tretment works. Tretment again, said Krier. We’ll re-admitt stressors at acme EMDR. Ready-made", "treatment tretment", None),
        ("https://h.com/b", None, "", "", ""),
        ("https://h.com/c", "acme", None, "McDonald isotoni newport carries", None),
    ]
    pages = spark.createDataFrame(rows, "url string, brand string, visible_text string, title string, meta_description string")
    words = "treatment works again said stressor ready made center carry".split()
    dictionary = spark.createDataFrame([(w, 9) for w in words] + [("treatments", 2), ("admit", 3), ("we'll", 5)], "token string, freq int")
    allowed = spark.createDataFrame([("Newport Beach",)], "token string")
    got = {(r.url[14:], r["class"], r.location, r.matched, r.fix) for r in mining.check_vocabulary(pages, dictionary, allowed).collect()}
    text, title = "page text", "search-result title"
    assert got == {
        ("a/treatmant-center/", "word", text, "tretment", "treatment"), ("a/treatmant-center/", "word#1", title, "tretment", "treatment"), ("a/treatmant-center/", "word", text, "re-admitt", None),
        ("a/treatmant-center/", "slug", "page address", "treatmant", "treatment"), ("c", "word", title, "isotoni", None),
    }
    assert mining.check_vocabulary(pages.limit(0), dictionary).count() == 0


def test_flat_lists_and_brands_without_numbers(spark):
    from siftwell.operators import reference_data

    pages = spark.createDataFrame([(f"u{b}", b, "call (212) 555-0123 or (310) 555-0199") for b in ("flat", "sheet", "none")], "url string, brand string, visible_text string")
    numbers = spark.createDataFrame([("flat", "+12125550123", "flat"), ("sheet", "+12125550123", "national")], "brand string, e164 string, kind string")
    got = {(r.url, r["class"], r.matched) for r in reference_data.check_phones_page(pages, numbers, judge_unlisted=False).collect()}
    want = {("uflat", "non_canonical", "+13105550199"), ("usheet", "unknown", "+13105550199")}
    assert got == want
    got = {(r.url, r["class"], r.matched) for r in reference_data.check_phones_page(pages, numbers).collect()}
    assert got == want | {("unone", "unknown", "+12125550123"), ("unone", "unknown", "+13105550199")}
