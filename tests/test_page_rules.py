"""Rules on small pages: what fires, and what stays silent."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siftwell.operators import page_rules as R
from siftwell.sources import extract


def parsed(spark, *pages):
    rows = [(f"https://www.example.com/{i}" if not isinstance(p, tuple) else p[0], p if not isinstance(p, tuple) else p[1]) for i, p in enumerate(pages)]
    return extract.extract_pages(spark.createDataFrame(rows, "url string, html string")).cache()


def classes(found):
    return sorted((r["url"].rsplit("/", 1)[1], r["class"]) for r in found.collect())


GOLDENS = [
    ("<p>Call <strong>now</strong>. Then wait</p>", "Call now. Then wait"),
    ("<p>one<b>,</b> two</p>", "one, two"),
    ("<h3>Heading</h3><p>Paragraph</p>", "Heading\nParagraph"),
    ("<a href='/a'>One</a> <a href='/b'>Two</a>", "One Two"),
    ("<p>in the <strong>middle</strong> of it</p>", "in the middle of it"),
    ("<ul><li>a<li>b<li>c<li>d</ul>", "a\nb\nc\nd"),
    ("<p>day , and</p>", "day , and"),
    ("<style>.c a span{display:none}</style><div class='c'><a>Go<span>secret</span></a></div>", "Go"),
    ("<p>seen<!-- not seen --></p><script>var x</script>", "seen"),
    ("<p hidden>x</p><p style='display: none'>y</p><p>z</p>", "z"),
    (None, ""), ("", ""), ("<p>open <b>never closed", "open never closed"),
]


def test_visible_text_goldens(spark):
    got = parsed(spark, *[h for h, _ in GOLDENS])
    texts = {r.url.rsplit("/", 1)[1]: r.visible_text for r in got.collect()}
    for i, (_, want) in enumerate(GOLDENS):
        assert texts[str(i)] == want


def test_extra_css_hides(spark):
    df = spark.createDataFrame([("u", "<p class='chip'>x</p><p>y</p>", ".chip{display:none}"), ("v", "<p class='chip'>x</p><p>y</p>", None)], "url string, html string, css string")
    got = {r.url: r.visible_text for r in extract.extract_pages(df, css_col="css").collect()}
    assert got == {"u": "y", "v": "x\ny"}


def test_links_regions_and_actionables(spark):
    html = "<nav><a href='/n'>n</a></nav><div class='site-footer'><a href='f#x'>f</a></div><article><header><h2>T</h2></header><a href='mailto:a@b'>m</a><a href='//h.com/x'>h</a><a href='http://['>bad</a></article>"
    r = parsed(spark, html).first()
    assert [x.url for x in r.links] == ["https://www.example.com/n", "https://www.example.com/f", "https://h.com/x"]
    assert [a.region for a in r.actionables] == ["nav", "footer", "body", "body", "body"]
    assert [b.region for b in r.blocks] == ["body"]


def test_meta(spark):
    p = spark.createDataFrame([("https://h.com/Bad_Slug", "", ""), ("https://h.com/step-by-step", "A title of a good length", "d"), ("https://h.com/page-2", "Brand name | Brand name", "d"), ("https://h.com/covid-19-2", "short", "d"), ("https://h.com/", None, None)], "url string, title string, meta_description string")
    got = {}
    for r in R.check_meta(p).collect():
        got.setdefault(r.url.rsplit("/", 1)[1], set()).add(r["class"])
    assert got == {"Bad_Slug": {"missing_title", "missing_desc", "malformed_slug"}, "page-2": {"repeated_segment", "collision_slug"}, "covid-19-2": {"title_length"}, "": {"missing_title", "missing_desc"}}


def test_headings(spark):
    p = parsed(spark, "<h1>a</h1><h3>x</h3><h2>y</h2><h1>b</h1>", "<h1>a</h1><h2></h2><h2>Services (Pillar)</h2><h2>Services (Pillar)</h2>", "<h1>a</h1><h2>b</h2><h3>c</h3>")
    assert classes(R.check_headings(p)) == [("0", "multi_h1"), ("0", "skipped"), ("1", "empty"), ("1", "label_leak"), ("1", "label_leak")]
    assert len({r.fingerprint for r in R.check_headings(p).collect()}) == 5


def text_pages(spark, *texts):
    return spark.createDataFrame([(f"u/{i}", t) for i, t in enumerate(texts)], "url string, visible_text string")


@pytest.mark.parametrize(
    "text,want",
    [
        ("Homes in , the county", ["orphan_comma"]), ("programs within of California", ["double_preposition"]), ("rose by %.", ["empty_percent"]),
        ("within 25 of Long Beach", ["missing_unit"]), ("within 30 days", []), ("within 3 to 5 days", []), ("ratings of at least 4", []), ("a total of Not found", ["not_found_sentinel"]),
        ("there are 1 facilities", ["count_disagreement"]), ("outcomes d compared", ["truncated_word"]), ("", []), (None, []),
    ],
)
def test_empty_slot(spark, text, want):
    assert sorted(r["class"] for r in R.check_empty_slot(text_pages(spark, text)).collect()) == want


@pytest.mark.parametrize(
    "text,want",
    [
        ("intro\nNo content found\nmore", ["empty_state"]), ("see [some_calculator] here", ["shortcode"]), ("see [1]", []), ("Rehab - GEO", ["variable_name"]), ("The GEO Group", []),
        ("[acf field=city] and {{name}} {{name}}", ["acf", "curly"]), ("Lorem ipsum dolor sit", ["lorem_ipsum"]),
    ],
)
def test_placeholder(spark, text, want):
    assert sorted(r["class"] for r in R.check_placeholder(text_pages(spark, text)).collect()) == want


@pytest.mark.parametrize(
    "text,want",
    [
        ("the the end. had had", ["doubled_word"]), ("It ends.Then starts, Dr.Smith", ["missing_space"]), ("soo sooon", ["repeated_letters"]), ("what?. no,, yes", ["stacked_punctuation"] * 2),
        ("see https://a.com/the and the.Com", []), ("the\nthe", []),
    ],
)
def test_corruption(spark, text, want):
    blocks = spark.createDataFrame([("u", 0, text)], "url string, pos int, text string")
    assert sorted(r["class"] for r in R.check_corruption(blocks).collect()) == want


def test_shattered_and_misspelled(spark):
    blocks = spark.createDataFrame([("u", 0, "Al ways fo llow t he inst ructions th at y ou g et fr om us"), ("u", 1, "All of these words are whole and so the block is left alone by it")], "url string, pos int, text string")
    assert R.check_shattered(blocks).count() == 1
    p = spark.createDataFrame([("https://h.com/residental-care", "Alchohol and heath; Heath is a name. alchohol")], "url string, visible_text string")
    assert sorted(r["class"] for r in R.check_known_misspellings(p).collect()) == ["body", "body", "body#1", "slug"]


def test_scope(spark):
    rows = [("https://h.com/a", "across the county", "PTSD"), ("https://h.com/orange-county", "across the county", "x"), ("https://h.com/b", "in the county of Kent", "Kent County care")]
    p = spark.createDataFrame(rows, "url string, visible_text string, title string").withColumn("headings", F.from_json(F.lit('[{"level":1,"text":"In the county"}]'), "array<struct<level:int,text:string>>"))
    assert sorted(r["class"] for r in R.check_scope(p).collect()) == ["county_for_country", "county_for_country"] or R.check_scope(p).count() == 2


def test_actions(spark):
    p = parsed(
        spark, "<a href='#' class='btn'>View All</a>", "<button>View All</button>", "<a href='#'>Menu</a><ul><li><a href='/a'>a</a><li><a href='/b'>b</a></ul>", "<a>plain chip</a>",
        "<a href='https://facebook.com/x' class='icon-instagram'></a>", "<a href='https://www.facebook.com/x' class='icon-facebook'></a>",
    )
    assert classes(R.check_dead_cta(p)) == [("0", "dead_cta")]
    assert classes(R.check_social_misrouted(p)) == [("4", "social_misrouted")]


def test_duplicates_on_a_page(spark):
    long = "This sentence has rather more than eighteen words in it so that the rule about the same paragraph twice can see it and fire."
    p = parsed(spark, f"<p>{long}</p><p>{long.upper()}</p><p>Learn more</p><p>Learn more</p>", "<ul><li><a href='/a'>A</a><li><a href='/a'>A</a></ul><p><a href='/b'>B</a></p><p><a href='/b'>B</a></p>")
    assert R.check_duplicate_paragraph(R.body_blocks(p)).count() == 1
    assert classes(R.check_duplicate_link(p)) == [("1", "duplicate_link")]


def test_empty_groups(spark):
    cell = lambda *v: "<table><tr>" + "".join(f"<td>{x}</td>" for x in v) + "</tr></table>"
    p = parsed(spark, cell("a", "", "c", "d", "e"), cell("a", "b", "c", "", ""), cell("a", "<i class='fa fa-x'></i>", "c", "d"), cell("a", "", "", "", "e", "f"))
    assert classes(R.check_empty_slot_group(p)) == [("0", "empty_row")]


def test_sister_brand(spark):
    texts = spark.createDataFrame([("u1", "A", "We love Beta House here", "x"), ("u2", "A", "our partner Beta House", "x"), ("u3", "A", "about Beta House", "Beta House review"), ("u4", "A", "Beta House and Gamma", "x"), ("u5", "B", "Beta House", "x")], "url string, brand string, text string, subject string")
    names = spark.createDataFrame([("A", "Alpha"), ("B", "Beta House"), ("C", "Gamma")], "brand string, name string")
    assert [r.url for r in R.check_sister_brand(texts, names).collect()] == ["u1"]


def test_markup(spark):
    p = parsed(spark, "<meta name='viewport' content='width=device-width, user-scalable=no'><a href='/x'></a><input type='text'>", "<a href='/x' aria-label='go'></a><label for='i'>n</label><input id='i'>")
    assert classes(R.check_markup_access(p)) == [("0", "label"), ("0", "link-name"), ("0", "meta-viewport")]


def test_empty_slot_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").cast("string").alias("url"), F.coalesce("text", F.lit("")).alias("visible_text"))
    want = []
    for cls, pattern, severity in R.EMPTY_SLOT:
        for old, new in ((r"[\d.]", "[0-9.]"), (r"[\w.\-]", r"[A-Za-z0-9_.\-]"), (r"\d", "[0-9]"), (r"\w", "[A-Za-z0-9_]"), (r"\s", r"[ \t\n\x0b\f\r]")):
            pattern = pattern.replace(old, new)
        for url, text in docs.collect():
            seen = Counter()
            for m in re.finditer(pattern, text):
                key = m.group().lower()
                slot = cls if not seen[key] else f"{cls}#{seen[key]}"
                seen[key] += 1
                parts = (" ".join(re.sub(r"[ \t\n\x0b\f\r]+", " ", p).split(" ")).strip(" ") for p in ("empty_slot", slot, url, key))
                want.append((url, slot, severity, m.group(), ":".join(p for p in parts if p)))
    got = R.check_empty_slot(docs).select("url", "class", "severity", "matched", "fingerprint").collect()
    assert want and sorted(map(tuple, got)) == sorted(want)


def test_signs_lose_no_match(spark):
    """Each class finds with its signs and quick patterns what its plain pattern finds, over texts made of bits of all of them."""
    import random
    from unittest import mock

    rng = random.Random(11)
    bits = ["[acf field='x", "[some_calculator]", "{{", "}}", "GEO", "CITY", "FULL_GEO", "NEAR-IN", " ", "  ", "\n", "in", "of", ",", " , ", "%", "Not found", "1", " beds", "b", "aaab", "word", "Word", ".", "word.Word", "no results found", "?!", ";;", "...."]
    texts = [(f"https://h.com/{i}", "".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randrange(1, 14)))) for i in range(1500)] + [("https://h.com/n", None)]
    pages = spark.createDataFrame(texts, "url string, visible_text string")
    blocks = pages.where("visible_text is not null").select("url", F.lit(0).alias("pos"), F.col("visible_text").alias("text"))
    find = lambda: [sorted((r["class"], r.fingerprint) for r in x.collect()) for x in (R.check_placeholder(pages), R.check_empty_slot(pages), R.check_corruption(blocks))]
    quick = find()
    with mock.patch.object(R, "may_hold", lambda text, cls: F.lit(True)):
        assert quick == find()
    found = {c.split("#")[0] for rows in quick for c, _ in rows}
    assert set(R.SIGNS) | set(R.PARTS) <= found
