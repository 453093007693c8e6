"""Plans whose cost must not outgrow their input: what is sent, carried or dealt again."""

import contextlib
import io
import random
import re

from pyspark.sql import functions as F

from siftwell.operators import mining, page_rules
from siftwell.plans import catalog, catalog_kernel, catalog_pages, catalog_streams
from siftwell.sources import elements


STORED = ["a30_hidden_text", "r_pages"]
assert catalog_kernel and catalog_pages


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(True)
    return out.getvalue()


def test_substrings_of_run_together_words_are_never_sent_to_the_tasks(spark):
    words = spark.createDataFrame([("bestrehabcenters",), ("qwertyuiopasdfgh",)], "token string")
    vocabulary = spark.createDataFrame([(w,) for w in ("best", "rehab", "centers")], "token string")
    split = mining.run_together(words, vocabulary)
    assert [tuple(r) for r in split.collect()] == [("bestrehabcenters", 3)]
    assert "Join LeftSemi" in plan(split)  # only the right side of a semi-join can be broadcast


def test_examples_are_cut_before_their_words_are_dealt(spark):
    rows = [("b", "u1", 0, "Alpha beside " + "filler " * 30 + "alpha again"), ("b", "u1", 1, "beside alpha"), ("b", "u2", 0, "alpha gamma")]
    blocks = spark.createDataFrame(rows, "brand string, url string, pos int, text string")
    got = mining.with_places_and_examples(mining.token_ledger(blocks), blocks, pad=10)
    shown = {r.token: (r.freq, r.example_url, r.example_text, r.placelike) for r in got.collect()}
    assert shown["alpha"] == (4, "u1", "Alpha beside fi", False) and shown["gamma"] == (1, "u2", "alpha gamma", False) and shown["again"][2].endswith("again")
    dealt = [line for line in plan(got).split("== Physical Plan ==")[0].splitlines() if "min_by(" in line]
    assert dealt and not any("whole" in line.split("min_by(")[1] for line in dealt)


def test_events_are_dealt_into_more_parts_as_pages_take_more(spark):
    """Partitions that Spark joins by their pressed size would grow with the input; a number that is asked for stays."""
    pages = spark.range(64).selectExpr("concat('https://a.example.com/', id) AS url", "'<h1>x</h1><p>y</p>' AS html")
    for parts in (1, 3):
        made = elements.events(pages.coalesce(parts))
        assert made.rdd.getNumPartitions() == elements.SPREAD * parts
        assert made.select("page").distinct().count() == 64


def test_landed_rows_are_not_written_by_one_task(spark, tmp_path):
    catalog_streams.land(spark.range(40).repartition(4), str(tmp_path / "landed"))
    assert len(list((tmp_path / "landed").glob("*.parquet"))) == 4


def test_rules_read_stored_pages(spark):
    for name in STORED:
        assert "MapInArrow" not in plan(catalog.QUERIES[name](spark, "/root/testdata/sf0.001"))


def test_unknown_words_count_the_documents_once(spark):
    assert "regexp_extract_all" not in plan(catalog.r12_unknown_words(spark, "/root/testdata/sf0.001"))  # the ledger is stored


def test_ledger_is_sorted_by_token_first_and_holds_what_the_plain_patterns_find(spark):
    rng = random.Random(3)
    bits = ["http://", "www.", ".com", ".html", "b.org", " ", "\n", "lorem", "Ipsum", "dolor-", "Kolor", "alpha", "Bravo’s", "charlie-", "'delta'", "éclair", "x", "İpsum", "_risus"]
    texts = [("b" * (i % 2), f"u{i}", "".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randrange(14)))) for i in range(600)] + [("b", "n", None)]
    blocks = spark.createDataFrame(texts, "brand string, url string, text string")
    got = mining.token_ledger(blocks)
    latin = F.col("text").rlike(r"(?i)\b(?:" + "|".join(page_rules.LOREM_PAGE) + r")\b") & (F.size(page_rules.lorem_markers(F.col("text"), page_rules.LOREM_PAGE)) >= 3)
    raw = F.explode(F.regexp_extract_all(F.regexp_replace("text", page_rules.URL_IN_TEXT, " "), F.lit(mining.TOKEN), F.lit(0)))
    words = blocks.where(~latin).select("brand", "url", raw.alias("raw")).withColumn("raw", F.regexp_replace("raw", "^['’-]+|['’-]+$", "")).withColumn("token", F.lower("raw")).where("token rlike '^[a-z]{5,}$'")
    want = words.groupBy("brand", "token").agg(F.count("*"), F.bool_or(F.col("raw").rlike("^[a-z]")), F.min("url"))
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(got) == rows(want) and len(rows(got)) > 10
    assert "SortAggregate(key=[token" in plan(got).replace(" ", "")


def test_contexts_are_dealt_as_one_hash_without_their_neighbours(spark):
    rows = [("a", f"u{i % 3}", i, w) for i, w in enumerate("alpha bravo gamma alpha bravo delta alpha gamma omega".split())] + [(None, "n", 0, "omega")]
    words = spark.createDataFrame(rows, "brand string, url string, at long, token string")
    only = lambda *w: spark.createDataFrame([(x,) for x in w], "token string")
    got = mining.domain_vocabulary(words, only("alpha", "omega"), only("gamma"))
    assert {(r.token, r.brands, r.contexts, r.freq) for r in got.collect()} == {("alpha", 1, 1, 3), ("omega", 1, 2, 2)}
    assert re.search(r"Aggregate \[token#\d+, context#\d+L\]", plan(got))


def test_words_are_judged_without_their_addresses(spark):
    pages = spark.createDataFrame([("https://h.com/a/treatmant", "acme", "Tretment works", "tretment", "")], "url string, brand string, visible_text string, title string, meta_description string")
    unknown = mining.unexplained_words(pages, spark.createDataFrame([("treatment", 2), ("works", 3)], "token string, freq int"))
    assert {tuple(r) for r in unknown.collect()} == {("acme", "tretment"), ("acme", "treatmant")}
    dealt = [line for line in plan(unknown).split("== Physical Plan ==")[0].split("== Optimized Logical Plan ==")[1].splitlines() if "Aggregate [" in line]
    assert dealt and not any("url" in line for line in dealt)


def test_words_of_pages_are_read_once_for_what_the_lists_explain(spark):
    pages = spark.createDataFrame([("http://a/b-word", "a", "some qwxrt here", "title", "")], "url string, brand string, visible_text string, title string, meta_description string")
    words = spark.createDataFrame([("some",), ("here",), ("title",), ("word",)], "token string")
    kept = []

    def keep(df, name):
        kept.append(name)
        return spark.createDataFrame(df.collect(), df.schema)

    got = mining.unexplained_words(pages, words, keep=keep)
    assert kept == ["words"] and "regexp_extract_all" not in plan(got).replace("regexp_extract_all(lower(concat_ws", "")  # but for the names of brands
    assert {tuple(r) for r in got.collect()} == {("a", "qwxrt")} == {tuple(r) for r in mining.unexplained_words(pages, words).collect()}
