"""Queries that send the given pages through the extraction, and blocks and links that follow from it.

The SQL cuts the same html into tags by pattern. What it needs to know of these pages is that links, lists and headings are closed,
that a paragraph ends where the next one, or the article, does, and that nothing is hidden.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwell.operators import collapse, links, mining
from siftwell.plans.catalog import D_SQL, kept, parsed, query, shared_folder, table, texts
from siftwell.sources import elements, extract
from siftwell.sources.versions import commit, read
from siftwell.streaming import incremental

# tags of a page in order, without what scripts, styles and comments hold
TAGS_SQL = r"""raw AS (SELECT page_id, url, html, regexp_extract_all(html, '(?s)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<[^>]+>') AS l FROM pages WHERE url IS NOT NULL AND html IS NOT NULL),
tg AS (SELECT page_id, unnest(l) AS raw_tag, generate_subscripts(l, 1) AS i FROM raw),
ev AS (SELECT page_id, i, raw_tag, lower(regexp_extract(raw_tag, '^</?([a-zA-Z0-9]+)', 1)) AS tag, starts_with(raw_tag, '</') AS ends FROM tg WHERE regexp_matches(raw_tag, '^</?[a-zA-Z]')),
st AS (SELECT *, sum(CASE WHEN tag = 'nav' THEN CASE WHEN ends THEN -1 ELSE 1 END ELSE 0 END) OVER w AS in_nav, sum(CASE WHEN tag = 'footer' THEN CASE WHEN ends THEN -1 ELSE 1 END ELSE 0 END) OVER w AS in_footer,
  sum(CASE WHEN tag = 'article' THEN CASE WHEN ends THEN -1 ELSE 1 END ELSE 0 END) OVER w AS in_article FROM ev WINDOW w AS (PARTITION BY page_id ORDER BY i)),
el AS (SELECT *, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) AS INT) AS number FROM st WHERE NOT ends)"""


@query(f"""WITH {TAGS_SQL} SELECT page_id, number, tag, CASE WHEN in_nav > 0 THEN 'nav' WHEN in_footer > 0 AND in_article = 0 THEN 'footer' ELSE 'body' END AS region, tag IN ('li', 'h1', 'p') AS leaf, true AS live, tag = 'a' AND false AS has_submenu,
  CAST(CASE WHEN tag IN ('li', 'p') THEN row_number() OVER (PARTITION BY page_id, tag ORDER BY number) ELSE 1 END AS INT) AS nth, CASE WHEN tag IN ('li', 'p') THEN count(*) OVER (PARTITION BY page_id, tag) ELSE 1 END AS siblings FROM el""")
def x_elements(spark, sf):
    """One row an element of the given pages, with what its interval says."""
    raw = table(spark, sf, "pages").where("url is not null and html is not null")
    return elements.elements(raw, keep=("page_id",)).select("page_id", "number", "tag", "region", "leaf", "live", "has_submenu", "nth", "siblings")


@query(rf"""WITH {TAGS_SQL}, hr AS (SELECT page_id, number, in_nav > 0 AS nav, regexp_extract(raw_tag, 'href="([^"]*)"', 1) AS href FROM el WHERE tag = 'a'), p AS (SELECT DISTINCT page_id, url, html FROM raw),
hl AS (SELECT page_id, href, min(number) AS first FROM hr GROUP BY page_id, href),
lk AS (SELECT page_id, count(*) AS n_links, sha1(string_agg(href, ' ' ORDER BY first)) AS hrefs FROM hl GROUP BY page_id),
se AS (SELECT page_id, count(*) AS n_actionables, count(*) FILTER (nav) AS in_nav, sha1(string_agg(path, ' ' ORDER BY k)) AS selectors FROM (SELECT page_id, nav, k, 'html>body>nav>ul>li' || CASE WHEN n > 1 THEN ':nth-of-type(' || k || ')' ELSE '' END || '>a' AS path
  FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY number) AS k, count(*) OVER (PARTITION BY page_id) AS n FROM hr)) GROUP BY page_id),
bl AS (SELECT page_id, count(*) FILTER (tag IN ('li', 'h1', 'p')) AS n_blocks, count(*) FILTER (tag IN ('li', 'h1', 'p') AND in_nav > 0) AS nav_blocks, count(*) FILTER (tag = 'h1') AS n_headings FROM el GROUP BY page_id)
SELECT page_id, n_links, hrefs, n_actionables, in_nav, selectors, n_blocks, nav_blocks, n_headings, sha256(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>', '', 'g')) AS content_hash
FROM p LEFT JOIN lk USING (page_id) LEFT JOIN se USING (page_id) LEFT JOIN bl USING (page_id)""")
def x_pages(spark, sf):
    """The given pages: links, places of links, blocks, regions and the hash of the markup without scripts and styles."""
    p = parsed(spark, sf)
    hashed = lambda c: F.when(F.size(c) > 0, F.sha1(F.array_join(c, " ").cast("binary")))
    some = lambda c: F.when(F.size("actionables") > 0, c)
    return p.select(
        "page_id", F.when(F.size("links") > 0, F.size("links")).cast("long").alias("n_links"), hashed(F.transform("links", lambda x: x["href"])).alias("hrefs"), some(F.size("actionables")).cast("long").alias("n_actionables"),
        some(F.size(F.filter("actionables", lambda a: a["in_nav"] & (a["region"] == "nav")))).cast("long").alias("in_nav"), hashed(F.transform("actionables", lambda a: a["selector"])).alias("selectors"),
        F.size("blocks").cast("long").alias("n_blocks"), F.size(F.filter("blocks", lambda b: b["region"] == "nav")).cast("long").alias("nav_blocks"), F.size("headings").cast("long").alias("n_headings"), "content_hash",
    )


@query()
def r_pages(spark, sf):
    """Every rule that needs nothing but the page, on each of the given pages. Tests hold it against the rules one by one."""
    return incremental.page_findings(kept(parsed(spark, sf), "parsed")).select("url", "check", "class", "fingerprint", "severity")


# ---- sentences as blocks

SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
SENTENCE_SQL = rf"""{D_SQL}, t AS (SELECT url, brand, txt || CASE WHEN doc_id % 3 <> 0 THEN chr(10) || 'This notice of ' || brand || ' stands on nearly every page of its site! ' ELSE '' END AS txt FROM d WHERE brand IS NOT NULL),
ln AS (SELECT url, brand, unnest(l) AS line, generate_subscripts(l, 1) AS a FROM (SELECT url, brand, string_split(txt, chr(10)) AS l FROM t)),
sn AS (SELECT url, brand, a, unnest(l) AS raw, generate_subscripts(l, 1) AS b FROM (SELECT url, brand, a, string_split(regexp_replace(line, '([.!?]){SPACE}+', '\1' || chr(1), 'g'), chr(1)) AS l FROM ln)),
sb AS (SELECT url, brand, a, b, trim(regexp_replace(raw, '{SPACE}+', ' ', 'g')) AS text FROM sn WHERE length(trim(regexp_replace(raw, '{SPACE}+', ' ', 'g'))) >= 40)"""


def sentences(spark, sf):
    """Sentences of the documents; two thirds of them end in a notice of their brand."""
    notice = F.concat(F.lit("\nThis notice of "), "brand", F.lit(" stands on nearly every page of its site! "))
    d = texts(spark, sf).where("brand is not null").withColumn("doc_id", F.regexp_extract("url", "[0-9]+$", 0).cast("long"))
    return collapse.sentence_blocks(d.select("brand", "url", F.concat("visible_text", F.when(F.col("doc_id") % 3 != 0, notice).otherwise("")).alias("text")))


@query(f"""WITH {SENTENCE_SQL}, p AS (SELECT brand, count(DISTINCT url) AS pages, CAST(sum(length(text)) AS BIGINT) AS chars FROM sb GROUP BY brand),
g AS (SELECT brand, text, count(DISTINCT url) AS on_pages, sum(length(text)) AS all_chars, max(length(text)) AS one FROM sb GROUP BY brand, text)
SELECT brand, max(pages) AS pages, max(chars) AS chars, round(sum(CASE WHEN on_pages >= greatest(2, ceil(pages * 0.3)) THEN all_chars ELSE 0 END) / max(chars), 6) AS boilerplate, round(1 - sum(one) / max(chars), 6) AS saving FROM g JOIN p USING (brand) GROUP BY brand""")
def a20_sentences(spark, sf):
    return collapse.boilerplate_share(sentences(spark, sf), share=0.3)


@query(f"""WITH {SENTENCE_SQL}, p AS (SELECT brand, count(DISTINCT url) AS pages FROM sb GROUP BY brand), g AS (SELECT brand, text, count(DISTINCT url) AS on_pages FROM sb GROUP BY brand, text)
SELECT brand, count(*) FILTER (on_pages < greatest(2, ceil(pages * 0.3))) AS unique_blocks, count(*) AS blocks FROM g JOIN p USING (brand) GROUP BY brand""")
def a21_sentences(spark, sf):
    s = sentences(spark, sf)
    kept = collapse.unique_blocks(s).groupBy("brand").agg(F.count("*").alias("unique_blocks"))
    return s.select("brand", "text").distinct().groupBy("brand").agg(F.count("*").alias("blocks")).join(kept, "brand", "left").na.fill(0, ["unique_blocks"])


# ---- link counts that follow changes


@query(rf"""WITH {TAGS_SQL}, e AS (SELECT DISTINCT page_id, regexp_extract(url, '^[^:]*://[^/?#]*') || regexp_extract(raw_tag, 'href="([^"]*)"', 1) AS target FROM el JOIN raw USING (page_id) WHERE tag = 'a'),
k AS (SELECT * FROM e WHERE page_id % 10 <> 1 AND NOT (page_id % 10 = 2 AND length(target) % 2 = 0)) SELECT target, count(*) AS page_count FROM k GROUP BY target""")
def l6_link_counts(spark, sf):
    """Counts of all pages but a tenth, kept, and moved by what a second crawl finds: that tenth added, another one removed, a third with fewer links.

    Neither crawl's other pages are read again. Targets come from the stored projection.
    """
    path = shared_folder(spark, "links")
    pages = extract.to_projection(parsed(spark, sf).withColumn("url", F.col("page_id").cast("string"))).select("url", "link_urls").withColumn("page_id", F.col("url").cast("long"))
    fewer = F.filter("link_urls", lambda x: F.length(x) % 2 != 0)
    first = pages.where("page_id % 10 <> 0")
    key = lambda name: (name, ())
    edges = links.link_edges(first)
    commit(spark, path, lambda _: {key("projection"): first, key("counts"): edges.groupBy("target").agg(F.count("*").alias("page_count"))})
    changed = pages.where("page_id % 10 in (0, 2)").withColumn("link_urls", F.when(F.col("page_id") % 10 == 2, fewer).otherwise(F.col("link_urls")))
    stored = read(spark, path, "projection").where("page_id % 10 in (1, 2)")
    return links.moved_counts(read(spark, path, "counts"), links.link_edges(stored), links.link_edges(changed))



# ---- mined typos with everything that acquits a word

PLANTED = "county treatment and tailortown chapel"
RARE = "near palm coutny, FL and tailertown, SC with treatmint or treatmant or treatmens"


@query(f"""WITH {D_SQL}, n AS (SELECT brand, count(*) AS n FROM d WHERE brand IS NOT NULL GROUP BY brand HAVING count(*) >= 5)
SELECT brand, unnest(['coutny', 'treatmint']) AS token, unnest(['county', 'treatment']) AS candidates FROM n""")
def j13_vetoes(spark, sf):
    """Every document is followed by a line of right words, the first one of a brand by rare ones too.

    Of these, a town before a state code is no mistake but a misspelled word of addresses is; a dictionary acquits one as it stands, another by its stem (treatmen for "treatmens").
    Only words of the planted lines are looked at, as others are the matter of j12.
    """
    d = texts(spark, sf).where("brand is not null")
    first = d.groupBy("brand").agg(F.min("url").alias("first"), F.count("*").alias("n")).where("n >= 5")
    lines = F.concat(F.array(F.lit(PLANTED)), F.when(F.col("url") == F.col("first"), F.array(F.lit(RARE))).otherwise(F.array().cast("array<string>")))
    planted = d.join(first, "brand").select("brand", "url", F.posexplode(lines).alias("pos", "text"))
    dictionary = spark.createDataFrame([("treatmant",), ("treatmen",)], "token string")
    found = mining.mined_typos(kept(mining.token_ledger(planted), "ledger"), dictionary, common_least=5, place_names=mining.places(planted))
    return found.select("brand", "token", F.array_join("candidates", " ").alias("candidates"))
