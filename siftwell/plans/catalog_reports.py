"""Queries of reports on runs, brands and sheets, of the stored projection, and of functions that others use unseen."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwell.functions import text as T
from siftwell.operators import history, links, mining, reference_data, serving
from siftwell.plans.catalog import CLASS_SQL, D_SQL, HOST, ROOT_SQL, SERVED_SQL, query, served, shared_folder, sites, table, texts
from siftwell.plans.catalog_more import RUN_ROWS, given, runs
from siftwell.plans.catalog_pages import TAGS_SQL
from siftwell.sources import elements, extract, readers
from siftwell.sources.versions import commit, read

# ---- landed pages


@query("""SELECT page_id, url, CAST(length(html) AS INT) AS chars FROM pages WHERE url IS NOT NULL AND html IS NOT NULL AND html <> '' AND page_id % 7 NOT IN (1, 2, 3) AND NOT contains(url, '/es/') AND NOT contains(url, 'utm_')""")
def s1_landed_pages(spark, sf):
    """Pages landed with what fetching said of them: of seven one timed out, one is missing and one came back empty. Two kinds of address are left out."""
    path = shared_folder(spark, "landed")
    k = F.col("page_id") % 7
    given(spark, sf).select(
        "page_id", "url", F.when(k == 3, "").otherwise(F.col("html")).alias("html"), F.when(k == 2, 404).when(k != 1, 200).alias("status"), F.when(k == 1, "timeout").alias("error")
    ).write.parquet(path)
    landed = readers.exclude_urls(readers.read_pages(spark, path), ["/es/", "utm_"])
    return landed.where(readers.is_ok()).select("page_id", "url", F.length("html").alias("chars"))


@query(r"""SELECT page_id, page_id % 5 = 0 OR regexp_matches(html, '(?i)<meta[^>]*name="robots"[^>]*noindex') AS is_noindex FROM pages WHERE url IS NOT NULL AND html IS NOT NULL""")
def x1_robots_header(spark, sf):
    """Of five pages one has a header that keeps it out of indexes, one a header that does not."""
    k = F.col("page_id") % 5
    raw = table(spark, sf, "pages").where("url is not null and html is not null")
    raw = raw.withColumn("robots", F.when(k == 0, "googlebot: NoIndex, nofollow").when(k == 1, "index, follow"))
    pages = extract.extract_pages(raw, keep=("page_id", "url", "robots"))
    return extract.to_projection(pages.withColumn("url", F.col("page_id").cast("string")), "robots").select(F.col("url").cast("long").alias("page_id"), "is_noindex")


# sheets of a host by the length of its name: none for a fifth; one that is read, missing, refused or unanswered; a harmless one for a third
SHEETS_SQL = f"""ho AS (SELECT DISTINCT {HOST.format(u="url")} AS brand FROM pages WHERE url IS NOT NULL),
hl AS (SELECT brand, length(brand) AS n FROM ho),
hs AS (SELECT brand, CASE WHEN n % 5 = 0 THEN 'none' WHEN n % 4 > 1 AND n % 3 <> 0 THEN 'unavailable' WHEN n % 4 > 1 THEN 'partial' ELSE 'ok' END AS css_status, n % 5 <> 0 AND n % 4 = 0 AS hides FROM hl)"""
SHEET = "/* article{display:none} */ @import url(more.css); @media print { footer { display: none } @supports (x) { p { display: none } } } nav , .none { color: red; display: none } p{margin:0}"


def sheets(spark, sf):
    brands = given(spark, sf).select(T.host(F.col("url")).alias("brand")).distinct()
    n = F.length("brand")
    first = F.struct(F.lit(0).alias("pos"), F.when(n % 4 == 0, 200).when(n % 4 == 1, 404).when(n % 4 == 2, 503).alias("status"), F.lit(SHEET).alias("body"))
    second = F.when(n % 3 == 0, F.struct(F.lit(1).alias("pos"), F.lit(200).alias("status"), F.lit("p{margin:0}").alias("body")))
    each = brands.where(n % 5 != 0).select("brand", F.explode(F.array_compact(F.array(first, second))).alias("s"))
    return brands, each.select("brand", "s.*", F.concat(F.lit("sheet"), F.col("s.pos").cast("string")).alias("url"), F.lit(False).alias("capped"))


@query(f"WITH {SHEETS_SQL} SELECT brand, css_status FROM hs")
def x9_css_status(spark, sf):
    brands, rows = sheets(spark, sf)
    return reference_data.css_health(rows, brands)


@query(f"""WITH {TAGS_SQL}, {SHEETS_SQL}, k AS (SELECT page_id, hides, tag, in_nav > 0 AS nav FROM el JOIN raw USING (page_id) JOIN hs ON brand = {HOST.format(u="url")})
SELECT page_id, count(*) FILTER (tag IN ('li', 'h1', 'p') AND NOT (nav AND hides)) AS n_blocks, count(*) FILTER (tag = 'a' AND NOT (nav AND hides)) AS n_actionables FROM k GROUP BY page_id""")
def x8_external_sheets(spark, sf):
    """The given pages with the sheets of their host: one hides all of nav, and other rules of it stand in comments and at-rules."""
    raw = table(spark, sf, "pages").where("url is not null and html is not null").withColumn("brand", T.host(F.col("url")))
    styled = raw.join(reference_data.hiding_styles(sheets(spark, sf)[1]), "brand", "left")
    p = extract.extract_pages(styled, css_col="css", keep=("page_id", "url"), parts=elements.parts_of(raw))
    return p.select("page_id", F.size("blocks").cast("long").alias("n_blocks"), F.size("actionables").cast("long").alias("n_actionables"))


# ---- links again from what is stored

RELINK_SQL = TAGS_SQL + rf""", e AS (SELECT DISTINCT url, {ROOT_SQL} || regexp_extract(raw_tag, 'href="([^"]*)"', 1) AS target FROM el JOIN raw USING (page_id) WHERE tag = 'a'
  UNION SELECT url, {ROOT_SQL} || CASE page_id % 4 WHEN 0 THEN '/a//b' WHEN 1 THEN '/page-copy-2/' WHEN 2 THEN '/feed/' ELSE '/cdn-cgi/l/x' END FROM raw),
s AS (SELECT DISTINCT url, regexp_replace({HOST.format(u="url")}, '^www\.', '') AS site FROM raw)"""


@query(f"""WITH {RELINK_SQL}, {CLASS_SQL} SELECT target, class, site, page_count, CASE WHEN class = 'cruft' THEN 'error' WHEN class IN ('double_slash', 'feed') THEN 'warning' END AS severity FROM k JOIN n USING (target)""")
def l6_relink(spark, sf):
    """The projection of the given pages, each with one link more of another class, is stored, and the link rules read only that."""
    path = shared_folder(spark, "relink")
    root, k = F.regexp_extract("url", "^[^:]*://[^/?#]*", 0), F.col("page_id") % 4
    odd = F.concat(root, F.when(k == 0, "/a//b").when(k == 1, "/page-copy-2/").when(k == 2, "/feed/").otherwise("/cdn-cgi/l/x"))
    raw = table(spark, sf, "pages").where("url is not null and html is not null")
    pages = extract.extract_pages(raw, keep=("page_id", "url")).withColumn("links", F.array_append("links", F.struct(odd.alias("href"), odd.alias("url"))))
    commit(spark, path, lambda _: {("projection", ()): extract.to_projection(pages)})
    return links.relink(read(spark, path, "projection"), sites(spark, sf)).select("target", "class", "site", "page_count", "severity")


# ---- runs and brands

# three runs of a brand: the third is waiting, running, failed or well by the length of its name; a seventh of the brands never ran, of some no run ended
BRANDS_SQL = f"""br AS (SELECT DISTINCT {HOST.format(u="url")} AS brand FROM pages WHERE url IS NOT NULL), bl AS (SELECT brand, length(brand) AS n FROM br)"""


def states(spark, sf):
    brands = given(spark, sf).select(T.host(F.col("url")).alias("brand")).distinct().withColumn("n", F.length("brand"))
    n, k = F.col("n"), F.col("run_id")
    each = brands.where(n % 7 != 0).withColumn("run_id", F.explode(F.when(n % 5 == 0, F.array(F.lit(3))).otherwise(F.array(*map(F.lit, (1, 2, 3))))))
    last = F.element_at(F.array(*map(F.lit, ("queued", "running", "failed", "ok"))), n % 4 + 1)
    return brands.select("brand", (n % 6 == 0).alias("fixed_list")), each.select(
        "brand", "run_id", k.alias("started_at"), F.when(k == 3, last).otherwise("ok").alias("status"), ((n + k) % 3 == 0).alias("partial_sample"), ((n % 11 == 0) & (k == 3)).alias("fixed_list")
    )


@query(f"""WITH {BRANDS_SQL}, c AS (SELECT *, CASE WHEN n % 7 = 0 OR (n % 5 = 0 AND n % 4 < 2) THEN 0 WHEN n % 4 < 2 THEN 2 ELSE 3 END AS last FROM bl)
SELECT brand, 'never' AS caveat FROM c WHERE last = 0 UNION ALL SELECT brand, 'stale' FROM c WHERE last = 3 AND n % 4 = 2 UNION ALL SELECT brand, 'in_flight' FROM c WHERE n % 7 <> 0 AND n % 4 < 2
UNION ALL SELECT brand, 'partial' FROM c WHERE last > 0 AND (n + last) % 3 = 0 UNION ALL SELECT brand, 'fixed_list' FROM c WHERE n % 6 = 0 OR (last = 3 AND n % 11 = 0)""")
def a34_data_caveats(spark, sf):
    return serving.data_caveats(*states(spark, sf))


@query(f"""WITH {BRANDS_SQL}, r AS (SELECT brand, n, CASE WHEN n % 4 = 3 THEN 3 WHEN n % 5 = 0 THEN NULL ELSE 2 END AS latest FROM bl WHERE n % 7 <> 0),
f AS (SELECT {HOST.format(u="url")} AS brand, page_id % 3 + 1 AS run_id, CASE WHEN page_id % 2 = 0 THEN 'accessibility' ELSE 'contrast' END AS "check" FROM pages WHERE url IS NOT NULL),
g AS (SELECT brand, "check", run_id, count(*) AS findings FROM f GROUP BY ALL), w AS (SELECT brand, latest, unnest(['accessibility', 'contrast']) AS "check" FROM r WHERE latest IS NOT NULL),
j AS (SELECT w.brand, w."check", latest, max(run_id) AS run_id, max_by(findings, run_id) AS findings, coalesce(bool_or(run_id = latest), false) AS current FROM w LEFT JOIN g ON w.brand = g.brand AND w."check" = g."check" GROUP BY w.brand, w."check", latest)
SELECT brand, "check", CAST(latest AS INT) AS latest, CAST(run_id AS INT) AS run_id, findings FROM j WHERE NOT current""")
def j11_stale_passes(spark, sf):
    """Findings of two separate passes: the page's id says which pass and on which run."""
    i = F.col("page_id")
    found = given(spark, sf).select(T.host(F.col("url")).alias("brand"), F.when(i % 2 == 0, "accessibility").otherwise("contrast").alias("check"), (i % 3 + 1).cast("int").alias("run_id"))
    return history.stale_passes(states(spark, sf)[1], found, ("accessibility", "contrast")).select("brand", "check", "latest", "run_id", "findings")


@query(SERVED_SQL + """ SELECT page_count AS run_id, count(*) FILTER (id % 3 = 0 AND id % 5 <> 0) AS open_errors, count(*) FILTER (status = 'new' AND id % 5 <> 0) AS new FROM sv GROUP BY page_count""")
def a14_run_list(spark, sf):
    """Findings of the served view, as if the number of their pages said on which run they are; a third of them are errors by their id and a fifth are resolved."""
    severity, status = F.when(F.col("id") % 3 == 0, "error").otherwise("warning"), F.when(F.col("id") % 5 == 0, "resolved").otherwise(F.col("status"))
    return serving.run_list(served(spark, sf).withColumns({"run_id": F.col("page_count"), "severity": severity, "status": status}))


@query(f"WITH {RUN_ROWS}, {D_SQL} SELECT (SELECT count(DISTINCT brand) FROM ru) AS brands, (SELECT count(*) FROM ru) AS runs, (SELECT count(*) FROM d) AS findings")
def a14_health(spark, sf):
    r = runs(spark, sf)
    return serving.health(r.select("brand").distinct(), r, texts(spark, sf))


# ---- numbers of several brands

# every brand lists a number of its own and one that some others list too, both by the hash of its name
DIGITS = "translate(substr(md5({x}), 1, 4), 'abcdef', '012345')"
DIAL_SQL = f"""db AS (SELECT DISTINCT brand, '+1415556' || {DIGITS.format(x="brand")} AS own, '+1628556000' || left({DIGITS.format(x="brand")}, 1) AS other FROM d WHERE brand IS NOT NULL),
ends AS (SELECT min(brand) AS lo, max(brand) AS hi FROM db), nu AS (SELECT brand, own AS e164 FROM db UNION SELECT brand, other FROM db),
li AS (SELECT url, d.brand, db.own AS shows, CASE doc_id % 5 WHEN 0 THEN lo.own WHEN 1 THEN hi.own WHEN 2 THEN '+16505560000' WHEN 3 THEN '+1650556' || {DIGITS.format(x="url")} ELSE hi.other END AS dials
  FROM d JOIN db ON d.brand = db.brand, ends JOIN db lo ON lo.brand = ends.lo JOIN db hi ON hi.brand = ends.hi),
o AS (SELECT * FROM (SELECT url, li.brand, dials, bool_or(nu.brand = li.brand) AS listed, count(DISTINCT nu.brand) AS others FROM li LEFT JOIN nu ON nu.e164 = dials WHERE shows <> dials GROUP BY url, li.brand, dials) WHERE listed IS NULL OR NOT listed)"""


def dialled(spark, sf):
    """Findings of one dial link for each document, and the lists. By its id it dials the first or the last brand, a number that all brands dial, one that few do, or one of several lists."""
    digits = lambda x: F.translate(F.substring(F.md5(x), 1, 4), "abcdef", "012345")
    docs = texts(spark, sf).where("brand is not null").select("url", "brand", "doc_id")
    own = lambda b: F.concat(F.lit("+1415556"), digits(b))
    other = lambda b: F.concat(F.lit("+1628556000"), F.substring(digits(b), 1, 1))
    lists = docs.select("brand").distinct().select("brand", F.explode(F.array(own(F.col("brand")), other(F.col("brand")))).alias("e164"), F.lit("location").alias("kind"))
    ends = docs.agg(F.min("brand").alias("lo"), F.max("brand").alias("hi"))
    k = F.col("doc_id") % 5
    dials = F.when(k == 0, own(F.col("lo"))).when(k == 1, own(F.col("hi"))).when(k == 2, "+16505560000").when(k == 3, F.concat(F.lit("+1650556"), digits(F.col("url")))).otherwise(other(F.col("hi")))
    link = F.struct(F.lit(1).alias("pos"), F.lit("a").alias("tag"), own(F.col("brand")).alias("text"), F.concat(F.lit("tel:"), dials).alias("href"))
    pages = docs.crossJoin(F.broadcast(ends)).select("url", "brand", F.array(link).alias("actionables"))  # the other side is one row
    return reference_data.check_phones_dial(pages, lists).join(docs.select("url", "brand"), "url"), lists


@query(f"""WITH {D_SQL}, {DIAL_SQL}, u AS (SELECT * FROM o WHERE others <> 1)
SELECT dials AS matched, count(*) AS findings, count(DISTINCT brand) AS brands, count(DISTINCT brand) > 1 AS shared, array_to_string(list_sort(list(DISTINCT url))[:3], ' ') AS pages FROM u GROUP BY dials""")
def a25_unlisted_numbers(spark, sf):
    return reference_data.unlisted_numbers(dialled(spark, sf)[0]).withColumn("pages", F.array_join("pages", " "))


@query(f"""WITH {D_SQL}, {DIAL_SQL} SELECT o.brand, nu.brand AS owner, count(DISTINCT dials) AS numbers, count(*) AS findings FROM o JOIN nu ON nu.e164 = dials WHERE others = 1 GROUP BY o.brand, nu.brand""")
def a25_leaks(spark, sf):
    """Calls that one brand's pages lead to another."""
    found, lists = dialled(spark, sf)
    return reference_data.cross_brand_rollup(found.where("class like 'cross_brand_dial%'"), reference_data.number_owners(lists))


@query("""WITH t AS (SELECT source || '/' || coalesce(lang, '') AS class, doc_id % 10 AS k FROM documents WHERE source IS NOT NULL),
w AS (SELECT class, count(*) AS attempted, count(*) FILTER (k < 4) AS captured, count(*) FILTER (k IN (4, 5)) AS uncapturable, count(*) FILTER (k IN (6, 7)) AS none, count(*) FILTER (k >= 8) AS many, count(*) FILTER (k >= 7) AS via_copies FROM t GROUP BY class),
i AS (SELECT class, attempted + length(class) % 2 AS wanted FROM w UNION ALL SELECT source, count(*) FROM documents WHERE source IS NOT NULL GROUP BY source)
SELECT class, coalesce(attempted, 0) AS attempted, coalesce(captured, 0) AS captured, coalesce(uncapturable, 0) AS uncapturable, coalesce(none, 0) AS none, coalesce(many, 0) AS many, coalesce(via_copies, 0) AS via_copies, wanted,
  round((captured + uncapturable) / attempted, 6) AS located, round(captured / attempted, 6) AS hit, CASE WHEN attempted IS NULL THEN 'not_measured' WHEN attempted < 10 THEN 'no_verdict' WHEN (captured + uncapturable) >= attempted * 0.6 THEN 'ships' ELSE 'below_floor' END AS verdict,
  coalesce(attempted, 0) > 0 AND coalesce(attempted, 0) < wanted AS partial FROM i LEFT JOIN w USING (class)""")
def a28_locator_report(spark, sf):
    """Attempts to find an element, one a document, by source and language; sources as a whole were wanted and never tried. The floor is 60 %, as that is near what is met."""
    k = F.col("doc_id") % 10
    docs = table(spark, sf, "documents").where("source is not null")
    tried = docs.select(F.concat("source", F.lit("/"), F.coalesce("lang", F.lit(""))).alias("class"), F.when(k < 4, "captured").when(k < 6, "uncapturable").when(k < 8, "none").otherwise("many").alias("outcome"), F.when(k >= 7, 2).otherwise(1).alias("copies"))
    one = tried.groupBy("class").agg((F.count("*") + F.first(F.length("class")) % 2).alias("wanted"))
    whole = docs.groupBy(F.col("source").alias("class")).agg(F.count("*").alias("wanted"))
    return mining.locator_report(tried, one.union(whole), floor=0.6)


# ---- functions


@query(rf"""WITH {D_SQL}, f AS (SELECT url, txt, strpos(txt, m) - 1 AS a, length(m) AS n FROM (SELECT url, txt, regexp_extract(txt, '[A-Za-z]{{10,}}') AS m FROM d) WHERE m <> '')
SELECT url, trim(substr(txt, greatest(a - 45, 0) + 1, a + n + 45 - greatest(a - 45, 0)), ' ') AS snippet FROM f""")
def v8_context(spark, sf):
    """What stands around the first word of ten letters or more."""
    t = texts(spark, sf).withColumn("m", F.regexp_extract("visible_text", "[A-Za-z]{10,}", 0)).where("m <> ''")
    start = F.instr(F.col("visible_text"), F.col("m")) - 1
    return t.select("url", T.context(F.col("visible_text"), start, start + F.length("m")).alias("snippet"))


@query("""WITH e AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events WHERE ts IS NOT NULL), p AS (SELECT day, strftime(day - INTERVAL 94 DAY, '%Y-%m-%d') || '..' || strftime(day - INTERVAL 3 DAY, '%Y-%m-%d') AS period FROM e)
SELECT period, strftime(day - INTERVAL 94 DAY, '%-d %b') || ' – ' || strftime(day - INTERVAL 3 DAY, '%-d %b %Y') AS label FROM p UNION ALL SELECT 'all of ' || strftime(day, '%Y-%m-%d'), 'all of ' || strftime(day, '%Y-%m-%d') FROM p""")
def v13_periods(spark, sf):
    """The default period as of each day with events, and one that is no range."""
    days = table(spark, sf, "events").where("ts is not null").select(F.to_date("ts").alias("day")).distinct()
    each = days.select(F.explode(F.array(T.default_period(F.col("day")), F.concat(F.lit("all of "), F.col("day").cast("string")))).alias("period"))
    return each.select("period", T.period_label(F.col("period")).alias("label"))
