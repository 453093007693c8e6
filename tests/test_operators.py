"""Operators over findings, runs, numbers, traffic, colours and words on small tables."""

import datetime

import pytest
from pyspark.sql import functions as F

from siftwell.functions import text as T
from siftwell.operators import collapse, contrast, history, links, mining, reference_data, serving, traffic


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_phone_numbers(spark):
    df = spark.createDataFrame([("(562) 555-0134",), ("1-800-273-TALK",), ("+1 562.555.0134",), ("123",), (None,), ("155-555-0134",)], "n string")
    assert [r[0] for r in df.select(T.e164_us(F.col("n"))).collect()] == ["+15625550134", "+18002738255", "+15625550134", None, None, None]
    assert spark.range(1).select(T.format_phone(F.lit("+15625550134"))).first()[0] == "(562) 555-0134"


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(T.fingerprint("a", F.lit(" b  c "), F.lit(""), F.lit(None).cast("string"))) == "a:b c"
    assert one(T.period_label(F.lit("2026-06-13..2026-09-12"))) == "13 Jun – 12 Sep 2026" and one(T.period_label(F.lit("x"))) == "x"
    assert one(T.default_period(F.lit("2026-09-15").cast("date"))) == "2026-06-13..2026-09-12"
    assert one(T.trim_sentence(F.lit("One two. Three four five."), 12)) == "One two."
    assert one(T.norm_address(F.lit("12 North Main Street, Suite 4"))) == "12 n main st ste 4"
    assert one(T.address_key(F.lit("12 Main St, Town CA 90210"))) == "12|90210"
    assert one(T.norm_whitespace(F.lit(" a  b​ "))) == "a b"


def test_links(spark):
    cases = [("http://gabapen", "malformed"), ("https://www.linkedin.cohttps://www.x.com/a", "fused"), ("https://e.com//x", "double_slash"), ("https://e.com/x?next=https://a//b", "probe"), ("https://e.com/a-copy-2", "cruft"),
             ("https://other.com/a-copy-2", "probe"), ("https://e.com/feed/", "feed"), ("https://staging.e.com/x", "staging"), ("https://e.com/cdn-cgi/x", None)]
    df = spark.createDataFrame(cases, "target string, want string").withColumn("got", links.link_class(F.col("target"), T.link_domain(T.host(F.col("target"))) == "e.com"))
    assert all(r.want == r.got for r in df.collect())
    edges = spark.createDataFrame([(f"u{i:02d}", "t") for i in range(12)], "url string, target string")
    r = links.sources_of(edges).first()
    assert r.page_count == 12 and len(r.sources) == 5 and r.truncated


def test_probes_and_mass_failure(spark):
    p = spark.createDataFrame([("https://e.com/a", "e.com", 403, None), ("https://x.com/a", "e.com", 403, None), ("https://x.com/b", "e.com", 404, None), ("https://e.com/c", "e.com", 200, "https://e.com/d"), ("https://e.com/e/", "e.com", 200, "https://e.com/e"), ("https://e.com/f", "e.com", None, None)], "target string, site string, status int, final_url string")
    assert rows(links.classify_probes(p), "target", "class") == [("https://e.com/a", "broken"), ("https://e.com/c", "redirected_internal"), ("https://e.com/f", "transport_error"), ("https://x.com/a", "unverified"), ("https://x.com/b", "broken")]
    f = spark.createDataFrame([("a", f"u{i}", 500) for i in range(5)] + [("a", "v", 200), ("b", "w", 404), ("b", "x", 200), ("b", "y", 200)], "brand string, url string, status int")
    assert rows(links.sitemap_failures(f), "brand", "class") == [("a", "crawl_incomplete"), ("b", "sitemap_dead")]


def test_scope_and_sitemaps(spark):
    a = spark.createDataFrame([(0, "http://e.com/a/"), (1, "http://e.com/b")], "pos int, url string")
    b = spark.createDataFrame([(0, "http://e.com/a"), (1, "http://e.com/c")], "pos int, url string")
    c = spark.createDataFrame([(0, "http://e.com/z")], "pos int, url string")
    assert rows(links.audit_scope(a, b, c), "url", "rank") == [("http://e.com/a", 0), ("http://e.com/b", 0), ("http://e.com/c", 1)]
    assert rows(links.audit_scope(a.limit(0), b.limit(0), c), "url") == [("http://e.com/z",)]
    stay, gone = links.off_brand(spark.createDataFrame([("http://www.e.com/a", "http://e.com/a"), ("http://e.com/b", "http://other.com/")], "url string, final_url string"))
    assert stay.count() == 1 and gone.first()["class"] == "redirects_off_brand"


def test_source_pattern(spark):
    audited = spark.createDataFrame([(f"http://h.com/{s}/{i}",) for s in "ab" for i in range(4)], "url string")
    hit = audited.withColumn("finding", F.lit("all")).union(audited.where("url like '%/a/%'").withColumn("finding", F.lit("a"))).union(audited.where("url like '%/b/_' and url not like '%3'").withColumn("finding", F.lit("part"))).union(audited.limit(1).withColumn("finding", F.lit("one")))
    assert rows(collapse.source_pattern(hit, audited), "finding", "pattern") == [("a", "http://h.com/a/*"), ("all", "http://h.com/*"), ("one", None), ("part", None)]


def test_diff_statuses(spark):
    f = "fingerprint string, url string, check string"
    prior = spark.createDataFrame([("p", "a", "x"), ("fixed", "a", "x"), ("moved", "a", "y"), ("removed", "gone", "x"), ("left", "alive", "x")], f).withColumn("first_seen", F.lit("then"))
    now = spark.createDataFrame([("p", "a", "x"), ("n", "a", "x")], f)
    urls = lambda *u: spark.createDataFrame([(x,) for x in u], "url string")
    got = history.diff_runs(prior, now, urls("a"), urls("a", "alive"), spark.createDataFrame([("y",)], "check string"))
    assert dict(rows(got, "fingerprint", "status")) == {"p": "persisting", "n": "new", "fixed": "resolved", "moved": "rule_changed", "removed": "page_removed", "left": "page_unsitemapped"}
    assert {r.fingerprint: r.first_seen for r in got.collect()}["p"] == "then"


def test_components_and_baselines(spark):
    c = "component string, value string"
    changed = history.changed_components(spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None)], c), spark.createDataFrame([("a", "1"), ("b", "2"), ("parse", "1"), ("c", None)], c))
    assert rows(changed, "component") == [("b",), ("parse",)]
    wiring = spark.createDataFrame([("b", "x"), ("d", "y")], "component string, check string")
    assert rows(history.checks_of_components(changed, wiring), "check") == [("x",), ("y",)]
    runs = spark.createDataFrame([(1, "s", 1, 1000, "d", "ok"), (2, "s", 2, 100, "d", "ok"), (3, "s", 3, 1000, "d", "ok")], "run_id int, brand string, started_at int, pages_audited int, report_dir string, status string")
    assert rows(history.baseline_run(runs), "run_id", "baseline") == [(1, None), (2, 1), (3, 1)]
    assert rows(history.poisoned_baseline(runs), "run_id", "previous") == [(3, 2)]
    verdicts = spark.createDataFrame([(1, 8029, 77, 30, 0, 0), (2, 0, 0, 0, 5, 0), (3, 10, 0, 0, 0, 10), (4, 10, 10, 9, 0, 0)], "run_id int, enumerated int, fetched int, ok int, blocked int, from_cache int")
    assert rows(history.crawl_verdict(verdicts), "run_id", "verdict") == [(1, "refused_low_yield"), (2, "refused_blocked"), (3, "ok"), (4, "ok")]
    trend = history.error_trend(runs.withColumn("errors", F.col("run_id") * 2), 2)
    assert rows(trend, "run_id", "scaled") == [(2, round(4 / 6, 6)), (3, 1.0)]


def test_triage(spark):
    current = spark.createDataFrame([("f1", "u", "x"), ("f2", "u", "x"), ("f3", "v", "y")], "fingerprint string, url string, check string")
    triage = spark.createDataFrame([("f1", "u", "x", "weird", "a", 0), ("f1", "u", "x", "fixed", "b", 1), ("old", "u", "x", "wontfix", "c", 2), ("", "v", "y", "fixed", "d", 3)], "fingerprint string, url string, check string, state string, note string, pos int")
    got = history.merge_triage(current, triage, spark.createDataFrame([("x",)], "check string"))
    assert rows(got, "fingerprint", "state", "note") == [("f1", "weird", "a"), ("f2", "open", "rule changed; was wontfix"), ("f3", "open", None)]
    t = "brand string, fingerprint_hash string, state string, note string, updated_at int"
    merged = history.upsert_triage(spark.createDataFrame([("b", "h", "open", "", 1)], t), spark.createDataFrame([("b", "h", "fixed", "", 2), ("b", "g", "open", "", 1)], t))
    assert rows(merged, "fingerprint_hash", "state") == [("g", "open"), ("h", "fixed")]


def test_attach_and_stale_passes(spark):
    found = spark.createDataFrame([("b", "a11y", "f1"), ("b", "a11y", "f2"), ("b", "a11y", "f3")], "brand string, check string, fingerprint string")
    earlier = spark.createDataFrame([("b", "a11y", 1, "f2", "old"), ("b", "a11y", 2, "f1", "then")], "brand string, check string, run_id int, fingerprint string, first_seen string")
    got = history.attach_pass(found, earlier, spark.createDataFrame([("f3",)], "fingerprint string"))
    assert rows(got, "fingerprint", "status", "first_seen") == [("f1", "persisting", "then"), ("f2", "new", None)]
    runs = spark.createDataFrame([(1, "b", 1, "ok"), (3, "b", 3, "ok")], "run_id int, brand string, started_at int, status string")
    assert rows(history.stale_passes(runs, earlier, ("a11y", "contrast")), "check", "run_id", "latest", "findings") == [("a11y", 2, 3, 1), ("contrast", None, 3, None)]
    later = earlier.selectExpr("brand", "check", "run_id + 1 as run_id")
    assert history.stale_passes(runs, later, ("a11y",)).count() == 0


def test_caveats_and_orders(spark):
    runs = spark.createDataFrame(
        [("a", 1, 1, "ok", True, False), ("a", 2, 2, "running", False, False), ("b", 1, 1, "ok", True, False), ("b", 2, 2, "failed", False, True), ("c", 1, 1, "queued", True, True), ("d", 1, 1, "ok", None, None)],
        "brand string, run_id int, started_at int, status string, partial_sample boolean, fixed_list boolean",
    )
    brands = spark.createDataFrame([("a", False), ("b", None), ("c", False), ("d", None), ("e", True)], "brand string, fixed_list boolean")
    got = serving.data_caveats(brands, runs)
    assert rows(got, "brand", "caveat") == [("a", "in_flight"), ("a", "partial"), ("b", "fixed_list"), ("b", "stale"), ("c", "in_flight"), ("c", "never"), ("e", "fixed_list"), ("e", "never")]
    f = spark.createDataFrame([("open", "warning", "2024", "h1"), ("open", "error", None, "h2"), ("fixed", "error", "2023", "h3")], "state string, severity string, first_seen string, fingerprint_hash string")
    assert [r.fingerprint_hash for r in serving.triage_order(f).collect()] == ["h2", "h1", "h3"]


def test_numbers_and_phones(spark):
    grid = spark.createDataFrame([(0, "A", "National", "562-555-0100", None), (1, "", "Office", "562-555-0101", "562-555-0102"), (2, "B", "National", "562-555-0200", "562-555-0201"), (3, None, "Office", None, "562-555-0200")], "row_no int, brand_cell string, channel string, number string, retired string")
    numbers = reference_data.parse_number_grid(grid).cache()
    assert rows(numbers, "brand", "e164", "kind") == [("A", "+15625550100", "national"), ("A", "+15625550101", "location"), ("A", "+15625550102", "retired"), ("B", "+15625550200", "national"), ("B", "+15625550201", "retired")]
    assert reference_data.validate_numbers(spark.createDataFrame([("A",), ("C",)], "brand string"), numbers).first().brand == "C"
    a = lambda href, text: {"pos": 1, "tag": "a", "text": text, "href": href}
    pages = spark.createDataFrame(
        [(f"u{i}", "A", [a(*x)], x[1]) for i, x in enumerate([("tel:562-555-0102", "562-555-0100"), ("tel:562-555-0101", "562-555-0100"), ("tel:562-555-0200", "562-555-0100"), ("tel:562-555-0999", "562-555-0100"), ("tel:562%20555%200100", "562-555-0100"), ("tel:12", "call"), ("tel:562-555-0100", "call us"), ("tel:+15625550100", "562-555-0100"), ("tel:562-555-0100%", "562-555-0100")])],
        "url string, brand string, actionables array<struct<pos:int,tag:string,text:string,href:string>>, visible_text string",
    )
    assert rows(reference_data.check_phones_dial(pages, numbers), "url", "class") == [("u0", "dials_retired"), ("u1", "display_dial_mismatch"), ("u2", "cross_brand_dial"), ("u3", "display_dial_unknown"), ("u4", "encoded_tel"), ("u5", "malformed")]
    texts = spark.createDataFrame([("v", "A", "562-555-0102 and 562-555-0888 and 562-555-0777 and 562-555-0100")], "url string, brand string, visible_text string")
    hot = spark.createDataFrame([("+15625550777",)], "e164 string")
    assert rows(reference_data.check_phones_page(texts, numbers, hot), "class", "matched") == [("hotline", "+15625550777"), ("retired", "+15625550102"), ("unknown", "+15625550888")]
    leaks = reference_data.cross_brand_rollup(spark.createDataFrame([("A", "+15625550200")], "brand string, matched string"), reference_data.number_owners(numbers))
    assert rows(leaks, "brand", "owner", "numbers") == [("A", "B", 1)]


def test_locations_and_structured_data(spark):
    cells = spark.createDataFrame([(4, "Name again", ["x", "x", "x", "x"]), (1, "Code", ["AA", None, "BB", None]), (2, "Name of place", ["One", "Two", "Three", "Four"]), (3, "Address", ["1 Main Street, Town CA 90210", "", "2 Oak Ave, Town CA 90211", "3 Elm Rd, Town CA 90212"])], "row_no int, row_label string, values array<string>")
    places = reference_data.parse_location_grid(cells).cache()
    assert rows(places, "brand", "name") == [("AA", "One"), ("BB", "Four"), ("BB", "Three")]
    ld = lambda s: [s]
    pages = spark.createDataFrame(
        [
            ("none", "AA", []), ("bad", "AA", ld("{oops")), ("org", "AA", ld('{"@type":"Organization","name":"Alpha"}')),
            ("graph", "AA", ld('{"@graph":[{"@type":"WebSite"},{"@type":["Thing","MedicalClinic"],"name":"Alpha care","telephone":"562-555-0100","address":{"streetAddress":"1 Main St","addressLocality":"Town","addressRegion":"CA","postalCode":"90210"}}]}')),
            ("local", "AA", ld('[{"@type":"LocalBusiness","name":"Other","telephone":"562-555-0200","address":"9 Nowhere Ln, Town CA 90000"}]')), ("gaps", "AA", ld('{"@type":"LocalBusiness","name":"Alpha"}')),
        ],
        "url string, brand string, json_ld array<string>",
    )
    numbers = spark.createDataFrame([("AA", "+15625550100", "national"), ("BB", "+15625550200", "national")], "brand string, e164 string, kind string")
    brands = spark.createDataFrame([("AA", "Alpha")], "brand string, name string")
    got = rows(reference_data.check_structured_data(pages, brands, numbers, places), "url", "class")
    assert got == [("bad", "invalid_json"), ("bad", "missing"), ("gaps", "no_address"), ("gaps", "no_telephone"), ("local", "address"), ("local", "name"), ("local", "phone_other_brand"), ("none", "missing")]
    sheets = spark.createDataFrame([("a", "x", 200, False), ("a", "y", 404, False), ("b", "x", 500, False), ("b", "y", 200, False), ("c", "x", None, False)], "brand string, url string, status int, capped boolean")
    assert rows(reference_data.css_health(sheets), "brand", "css_status") == [("a", "ok"), ("b", "partial"), ("c", "unavailable")]
    more = sheets.union(spark.createDataFrame([("d", "x", 410, False), ("e", "x", 410, False), ("e", "y", 503, False), ("f", "x", 200, True)], sheets.schema))
    brands = spark.createDataFrame([(b,) for b in "adefg"], "brand string")
    assert rows(reference_data.css_health(more, brands), "brand", "css_status") == [("a", "ok"), ("d", "ok"), ("e", "unavailable"), ("f", "partial"), ("g", "none")]


def test_only_top_level_rules_that_hide_reach_the_pages(spark):
    body = "/* .a{display:none} */ @import url(x); @media print { .b { display: none } @supports (x) { .c { display:none } } } .d , .e { color: red; Display : none } .f { color: blue } .g{visibility:hidden} .h { display: none"
    sheets = spark.createDataFrame([("a", 1, 200, body), ("a", 0, 200, ".z{display:none}"), ("a", 2, 500, ".y{display:none}"), ("b", 0, 200, "p{color:red}"), ("c", 0, 200, None)], "brand string, pos int, status int, body string")
    got = {r.brand: [r.strip() for r in r.css.split("\n")] for r in reference_data.hiding_styles(sheets).collect()}
    assert got == {"a": [".z{display:none}", ".d , .e { color: red; Display : none }", ".g{visibility:hidden}"]}


def test_unlisted_numbers_and_locators(spark):
    found = spark.createDataFrame(
        [("a", f"u{i}", "display_dial_unknown#2", "1") for i in range(5)] + [("b", "v", "display_dial_ambiguous", "1"), ("b", "v", "cross_brand_dial", "2"), (None, "w", "display_dial_unknown", "3")],
        "brand string, url string, class string, matched string",
    )
    assert rows(reference_data.unlisted_numbers(found), "matched", "findings", "brands", "shared", "pages") == [("1", 6, 2, True, ["u0", "u1", "u2"]), ("3", 1, 0, False, ["w"])]
    tries = [("good", "captured", 1)] * 6 + [("good", "uncapturable", 1)] + [("good", "many", 3)] * 3 + [("bad", "none", 0)] * 4 + [("bad", "captured", 2)] * 6 + [("few", "captured", 1)]
    attempts = spark.createDataFrame(tries, "class string, outcome string, copies int")
    intended = spark.createDataFrame([("good", 10), ("bad", 12), ("never", 4)], "class string, wanted int")
    got = rows(mining.locator_report(attempts, intended), "class", "attempted", "located", "hit", "via_copies", "verdict", "partial")
    assert got == [("bad", 10, 0.6, 0.6, 6, "below_floor", True), ("few", 1, 1.0, 1.0, 0, "no_verdict", False), ("good", 10, 0.7, 0.6, 3, "ships", False), ("never", 0, None, None, 0, "not_measured", False)]


def test_run_together_takes_the_furthest_end(spark):
    vocabulary = spark.createDataFrame([(w,) for w in ["alcohol", "use", "disorder", "best", "rehab", "centers", "disorderaud", "alcoholuse"]], "token string")
    blocks = spark.createDataFrame([("u", "an alcoholusedisorderaud bestrehabcenters, www.bestrehabcenters.com"), ("v", "bestrehabcenters.org xbestrehabcenterséx BESTREHABCENTERS"), ("w", "bestrehabcenters bestrehabcenters"), ("x", None)], "url string, text string")
    got = mining.check_run_together(blocks, vocabulary)
    assert rows(got, "url", "matched", "issue") == [("u", "bestrehabcenters", "3 words run together"), ("w", "bestrehabcenters", "3 words run together")]  # the furthest split of the other has two words


def test_traffic(spark):
    raw = spark.createDataFrame([("k", 0, 5, 10, 1.0), ("k", 1, 2, 30, 2.0), ("k", 2, 1, 30, 3.0), ("n", 0, None, None, None)], "url_key string, pos int, clicks int, impressions int, position double")
    assert rows(traffic.aggregate_traffic(raw), "url_key", "clicks", "impressions", "position") == [("k", 8, 30, 2.0), ("n", None, None, None)]
    at = datetime.datetime(2024, 1, 1)
    imports = spark.createDataFrame([("b", "2024-01", "csv", at, 1000), ("b", "2024-02", "csv", at, 1000), ("b", "2024-02", "api", at, 50)], "brand string, period string, source string, fetched_at timestamp, rows_read int")
    t = spark.createDataFrame([("b", "2024-02", "csv", "k", 1, 1, "unknown"), ("b", "2024-02", "api", "k", 2, 2, "measured")], "brand string, period string, source string, url_key string, clicks int, impressions int, value_state string")
    assert rows(traffic.select_traffic_period(t, imports), "source", "clicks", "measured", "capped") == [("api", 2, True, False)]
    u = lambda n: f"https://e.com/{n}"
    members = [("g", u(1), None, 1), ("g", u(1), None, 1), ("g", u(9), [u(1), u(2)], 2), ("h", u(1), [u(1), u(2)], 2), ("h", u(3), [u(3)], 1343), ("i", u(1), None, 100), ("i", u(2), None, 50), ("j", u(1), None, None)]
    members = spark.createDataFrame(members, "group string, url string, sources array<string>, page_count int")
    assert rows(traffic.union_reach(members), "group", "pages", "complete") == [("g", 2, True), ("h", 1345, False), ("i", 150, False), ("j", 1, True)]
    fold = traffic.fold_sibling_host(spark.createDataFrame([("www.a.com/x",), ("www.b.com/x",)], "url_key string"), spark.createDataFrame([("www.a.com", "a.com")], "from_host string, to_host string"))
    assert rows(fold, "url_key") == [("a.com/x",), ("www.b.com/x",)]


def test_reach_sentences_and_details(spark):
    cases = [("weighted", 2, 9, 2, 1, 1200, 1, False, True, ""), ("zero", 1, 1, 1, 0, 0, 0, None, True, ""), ("unmatched", 3, 3, 0, 0, 0, 0, True, True, ""), ("unmatched", 1, 1, 0, 0, 0, 0, None, True, ""), ("by_design", 1, 1, 0, 0, 0, 0, None, True, "why"), ("not_connected", 1, 1, 0, 0, 0, 0, None, True, "")]
    names = "state known total matched clicks impressions busiest capped measured reason".split()
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, state string, known int, total int, matched int, clicks int, impressions int, busiest int, capped boolean, measured boolean, reason string")
    c = {n: F.col(n) for n in names}
    said = [r[0] for r in df.orderBy("i").select(traffic.reach_sentence(period=F.lit("May"), **c)).collect()]
    assert said[0] == "Traffic in May: at least 1 visit, 1,200 impressions; top page 1 visit (2 of 9 pages looked up)."
    assert said[1:] == ["Traffic in May: none measured.", "No traffic row: list cut at its limit.", "No traffic row: list of unknown extent.", "why", ""]
    told = spark.createDataFrame([('{"class":"x","n":3}',), ("{broken",), (None,)], "d string").select(T.detail(F.col("d"), "class"), T.detail(F.col("d"), "n"))
    assert [tuple(r) for r in told.collect()] == [("x", "3"), (None, None), (None, None)]


def test_severities_are_merged_by_rank(spark):
    found = spark.createDataFrame([(f"https://e.com/{i}", "c", "x", f"f{i}", s, "same 1", None) for i, s in enumerate(["info", "warning", "warning"])], "url string, check string, class string, fingerprint string, severity string, matched string, snippet string")
    assert rows(collapse.collapse_repeats(found, checks=("c",)), "severity", "page_count") == [("warning", 3)]
    phones = found.withColumn("class", F.lit("unknown"))
    assert rows(collapse.collapse_phone(phones), "severity", "page_count") == [("warning", 3)] and collapse.phone_sources(phones).count() == 3


def test_added_pages_boards_and_health(spark):
    f = spark.createDataFrame([("u", "enumeration", "noindex_unsitemapped"), ("u", "meta", "thin"), ("u", "phone", "unknown"), ("u", "phone", "malformed"), ("v", "meta", "thin")], "url string, check string, class string")
    assert rows(serving.on_added_pages(f), "check", "class") == [("meta", "thin"), ("phone", "malformed")]
    assert rows(serving.health(f, f.limit(2), f.limit(0)), "brands", "runs", "findings") == [(5, 2, 0)]
    r = spark.createDataFrame([("r1", "error", "new"), ("r1", "error", "resolved"), ("r1", "info", "new")], "run_id string, severity string, status string")
    assert rows(serving.run_list(r), "run_id", "open_errors", "new") == [("r1", 1, 2)]


def test_reach_counts_a_destination_once(spark):
    pages_of = spark.createDataFrame([(1, "a", 1), (1, "b", 1), (2, "c", 9)], "id int, url_key string, total int")
    t = spark.createDataFrame([("b", 5, 50), ("a", 7, 70)], "url_key string, clicks int, impressions int")
    got = traffic.finding_reach(pages_of, t, spark.createDataFrame([("a", "b")], "url_key string, final_key string"))
    assert rows(got, "id", "known", "total", "matched", "clicks") == [(1, 2, 2, 1, 5), (2, 1, 9, 0, 0)]


def test_contrast(spark):
    pairs = spark.createDataFrame([("#fff", "#8a8a8a", 4.5), ("#1989ff", "#ffffff", 4.5), ("#000", "#fff", 4.5), ("oops", "#fff", 4.5)], "fg string, bg string, required double")
    got = {r.fg: r.suggested for r in contrast.nearest_passing(pairs).collect()}
    assert got["#000"] == "#000000" and got["oops"] is None
    ratio = lambda a, b: spark.range(1).select(contrast.contrast_ratio(contrast.channels(F.lit(a)), contrast.channels(F.lit(b)))).first()[0]
    assert ratio("#000000", "#ffffff") == pytest.approx(21) and ratio(got["#fff"], "#8a8a8a") >= 4.5 and ratio(got["#1989ff"], "#ffffff") >= 4.5
    measured = spark.createDataFrame([("u1", "#1989ff", "#fff", 3.5, 4.5, "a"), ("u2", "#1989ff", "#fff", 3.4, 4.5, "b"), ("u2", "#1989ff", "#fff", 3.4, 3.0, "c")], "url string, fg string, bg string, ratio double, required double, selector string")
    assert rows(contrast.collapse_contrast(measured), "required", "elements", "pages", "ratio") == [(3.0, 1, 1, 3.4), (4.5, 2, 2, 3.4)]


def test_mining(spark):
    words = [("b", w, n, low, f"u{w}") for w, n, low in [("treatment", 500, True), ("treatmnet", 1, True), ("treatments", 1, True), ("tretment", 2, True), ("Xanax".lower(), 3, False), ("colour", 1, True), ("color", 200, True), ("behaviour", 1, True), ("behavior", 300, True), ("retreatment", 1, True)]]
    ledger = spark.createDataFrame(words, "brand string, token string, freq int, ever_lower boolean, example_url string")
    dictionary = spark.createDataFrame([("treatment",)], "token string")
    typos = mining.mined_typos(ledger, dictionary).cache()
    assert rows(typos, "token") == [("behaviour",), ("colour",), ("treatmnet",), ("tretment",)]
    assert rows(mining.british_variants(typos), "class", "token", "n") == [("british_spelling", "", 2), ("mined", "treatmnet", 1), ("mined", "tretment", 1)]
    vocabulary = spark.createDataFrame([(w,) for w in ["alcohol", "use", "disorder", "best", "rehab", "centers"]], "token string")
    glued = spark.createDataFrame([("alcoholusedisorderaud",), ("bestrehabcenters",), ("disproportionately",)], "token string")
    assert rows(mining.run_together(glued, vocabulary), "token", "parts") == [("alcoholusedisorderaud", 3), ("bestrehabcenters", 3)]
    gate = mining.coverage_gate(typos, spark.createDataFrame([("b", 100, 80, False)], "brand string, pages int, read int, partial boolean"))
    assert gate.count() == 0


def test_edit_distance_join_misses_nothing(spark):
    import itertools

    letters = ["".join(p) for n in (1, 2, 3) for p in itertools.product("abc", repeat=n)]
    df = spark.createDataFrame([("x", w) for w in letters], "brand string, token string")

    def near(a, b):
        edits = {a[:i] + a[i + 1 :] for i in range(len(a))} | {a[:i] + c + a[i + 1 :] for i in range(len(a)) for c in "abc"} | {a[:i] + c + a[i:] for i in range(len(a) + 1) for c in "abc"}
        edits |= {a[:i] + a[i + 1] + a[i] + a[i + 2 :] for i in range(len(a) - 1)}
        return a != b and b in edits

    want = sorted((a, b) for a in letters for b in letters if near(a, b))
    assert rows(mining.fuzzy_pairs(df, df), "rare", "common") == want


def test_forward_fill_over_ranges(spark):
    import random

    from siftwell.operators.ordered import forward_fill

    rng = random.Random(1)
    data = [(i, rng.choice([None, None, None, f"v{i}"])) for i in rng.sample(range(5000), 700)] + [(None, "lost"), (None, None)]
    df = spark.createDataFrame(data, "n long, v string").repartition(7)
    got = {r.n: r.f for r in forward_fill(df, "n", "v", "f", size=10, levels=4).where("n is not null").collect()}
    last, want = None, {}
    for n, v in sorted(x for x in data if x[0] is not None):
        last = v if v is not None else last
        want[n] = last
    assert got == want and forward_fill(df, "n", "v", "f", size=10).count() == len(data) and forward_fill(df.limit(0), "n", "v", "f").count() == 0


def test_names_are_met_by_their_rarest_word(spark):
    from siftwell.operators import page_rules

    texts = [(f"u{i}", "a", "The quick place The Foo", "") for i in range(50)] + [("x", "a", "Visit The Bar House today", ""), ("y", "a", "The Bar-House", ""), ("z", "b", "our Ünion Café Bar", ""), ("w", "b", "株式 会社名 here", ""), ("v", "a", "in Bar House and 会社名", "")]
    df = spark.createDataFrame(texts, "url string, brand string, text string, subject string")
    names = spark.createDataFrame([("c", "The Bar House"), ("d", "Bar House"), ("e", "Café Bar"), ("f", "会社名"), ("g", "The Missing"), ("h", "--")], "brand string, name string")
    met = page_rules.texts_with_names(df, names.selectExpr("brand other", "name", "'' pattern"))
    assert rows(met.where("name = 'The Missing'"), "url") == [] and met.where("name = 'The Bar House'").select("url").distinct().count() == 3
    assert rows(page_rules.check_sister_brand(df, names), "url", "matched") == [("w", "会社名"), ("z", "Café Bar")]
    one = names.where("brand = 'd'")
    assert rows(page_rules.check_sister_brand(df, one), "url", "matched") == [("v", "Bar House"), ("x", "Bar House")]


def test_proportional_sample_of_few_and_one_section(spark):
    pages = spark.createDataFrame([(f"https://h.com/{s}/{i}",) for s, n in (("a", 90), ("b", 9), ("c", 1)) for i in range(n)], "url string")
    counts = lambda n, df: {r.section: r["count"] for r in serving.stratified_proportional(df, n).groupBy("section").count().collect()}
    assert counts(5, pages) == {"a": 4, "b": 1} and counts(200, pages) == {"a": 90, "b": 9, "c": 1}
    assert counts(3, pages.where("url like '%/a/%'")) == {"a": 3} and counts(3, pages.limit(0)) == {}
