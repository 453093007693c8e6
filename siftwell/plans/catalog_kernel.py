"""Queries over pages that are made of the documents' words: html, through the kernel, to the rules.

A page has its title and first heading from the first words of a document and all of its words as a paragraph; the length of the text decides which one defect
of twelve it has besides. The SQL says what must be found from that construction alone, without parsing.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwell.functions import text as T
from siftwell.operators import collapse, mining, page_rules, serving
from siftwell.plans.catalog import HOST, RULE_COLUMNS, SITE_MISTAKES, fp, kept, query, shared_folder, table
from siftwell.sources import extract
from siftwell.streaming import incremental

# what stands in the head and in the body of a page of kind k; {t} and {p} are its title and paragraph
HEAD = {1: '<meta name="viewport" content="width=device-width, user-scalable=no">', 5: '<meta name="robots" content="noindex, follow">'}
AFTER_H1 = {2: "<h1>{t} (copy)</h1>", 3: "<h3>deep</h3>", 4: "<h2> </h2>"}
AFTER_P = {
    0: "<p>[some_calculator] lorem ipsum dolor</p>",
    1: '<p><a href="/x"></a><input type="text"></p>',
    5: "<p hidden>lorem ipsum dolor sit amet</p>",
    6: "<p>{p}</p>",
    7: "<ul><li>one</li><li></li><li>three</li><li>four</li><li>five</li></ul>",
    8: '<p><a href="#" class="btn">View more</a></p>',
    9: '<p><a href="https://www.facebook.com/x" aria-label="instagram"></a></p>',
    10: "<p>Serving across the county today</p>",
    11: '<ul><li><a href="/a">Same</a></li><li><a href="/a">Same</a></li></ul>',
}
PARTS = ("<html><head><title>", "</title>", "</head><body><nav><ul><li><a href=\"/\">Home</a></li></ul></nav><h1>", "</h1>", "<p>", "</p>", "</body></html>")


def _choice(kinds: dict[int, str]):
    out = F.lit("")
    for k, text in kinds.items():
        made = F.lit("")
        for i, piece in enumerate(text.replace("{p}", "\0p\0").replace("{t}", "\0t\0").split("\0")):
            made = F.concat(made, F.col({"t": "title_text", "p": "para"}[piece]) if i % 2 else F.lit(piece))
        out = F.when(F.col("k") == k, made).otherwise(out)
    return out


def made_pages(spark, sf):
    """url, html, brand, doc_id, k of a page for each document."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf, "documents").select("doc_id", F.col("source").alias("brand"), (F.length(text) % 12).alias("k"), F.regexp_extract_all(text, F.lit("[a-z]{3,}"), F.lit(0)).alias("w"))
    words = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    docs = docs.withColumns({"title_text": words(1, 5), "descr": words(6, 7), "para": F.array_join("w", " ")})
    url = F.concat(F.lit("https://"), F.coalesce("brand", F.lit("none")), F.lit(".example.com/"), F.coalesce(F.get("w", F.lit(0)), F.lit("x")), F.lit("/"), F.col("doc_id").cast("string"))
    meta = F.when(F.col("k") % 3 == 0, F.concat(F.lit('<meta name="description" content="'), F.col("descr"), F.lit('">'))).otherwise("")
    a, b, c, d, e, f, g = [F.lit(p) for p in PARTS]
    html = F.concat(a, "title_text", b, meta, _choice(HEAD), c, "title_text", d, _choice(AFTER_H1), e, "para", f, _choice(AFTER_P), g)
    return docs.select(url.alias("url"), html.alias("html"), "brand", "doc_id", F.col("k").cast("int").alias("k"))


def made_parsed(spark, sf):
    return extract.extract_pages(made_pages(spark, sf), keep=("url", "brand", "doc_id"))


def _sql_choice(kinds: dict[int, str]) -> str:
    value = lambda t: "'" + t.replace("{t}", "' || title || '").replace("{p}", "' || para || '") + "'"
    return "CASE k " + " ".join(f"WHEN {k} THEN {value(t)}" for k, t in kinds.items()) + " ELSE '' END"


MP_SQL = f"""mw AS (SELECT doc_id, source AS brand, length(coalesce(text, '')) % 12 AS k, regexp_extract_all(coalesce(text, ''), '[a-z]{{3,}}') AS w FROM documents),
mt AS (SELECT *, 'https://' || coalesce(brand, 'none') || '.example.com/' || coalesce(w[1], 'x') || '/' || doc_id AS url, coalesce(array_to_string(w[1:5], ' '), '') AS title,
  coalesce(array_to_string(w[6:12], ' '), '') AS words_after, coalesce(array_to_string(w, ' '), '') AS para FROM mw),
mp AS (SELECT *, CASE WHEN k % 3 = 0 THEN words_after ELSE '' END AS descr, [{{'level': 1, 'text': title}}] || CASE k WHEN 2 THEN [{{'level': 1, 'text': trim(title || ' (copy)')}}] WHEN 3 THEN [{{'level': 3, 'text': 'deep'}}] WHEN 4 THEN [{{'level': 2, 'text': ''}}] ELSE [] END AS headings,
  array_to_string(list_filter(['Home', title, CASE k WHEN 2 THEN trim(title || ' (copy)') WHEN 3 THEN 'deep' ELSE '' END, para,
    CASE k WHEN 0 THEN '[some_calculator] lorem ipsum dolor' WHEN 6 THEN para WHEN 7 THEN 'one' || chr(10) || 'three' || chr(10) || 'four' || chr(10) || 'five' WHEN 8 THEN 'View more' WHEN 10 THEN 'Serving across the county today' WHEN 11 THEN 'Same' || chr(10) || 'Same' ELSE '' END], lambda x: x <> ''), chr(10)) AS vis,
  '{PARTS[0]}' || title || '{PARTS[1]}' || CASE WHEN k % 3 = 0 THEN '<meta name="description" content="' || words_after || '">' ELSE '' END || {_sql_choice(HEAD)} || '{PARTS[2]}' || title || '{PARTS[3]}' || {_sql_choice(AFTER_H1)} || '{PARTS[4]}' || para || '{PARTS[5]}' || {_sql_choice(AFTER_P)} || '{PARTS[6]}' AS html FROM mt)"""


def _kind(k: int, check: str, cls: str, severity: str, *key: str) -> str:
    quoted = [f"'{check}'", f"'{cls}'", "url", *key]
    return f"SELECT url, '{cls}' AS class, {fp(*quoted)} AS fingerprint, '{severity}' AS severity FROM mp WHERE k = {k}"


HEADINGS_SQL = rf"""hs AS (SELECT url, unnest(headings) AS x, generate_subscripts(headings, 1) - 1 AS pos FROM mp), o AS (SELECT url, x.level AS level, x.text AS text, pos FROM hs WHERE x.level <= 3),
l AS (SELECT *, lag(level) OVER (PARTITION BY url ORDER BY pos) AS prev FROM o),
lk AS (SELECT *, row_number() OVER (PARTITION BY url, level, text ORDER BY pos) - 1 AS nth FROM o WHERE regexp_matches(lower(text), '\(pillar\)|\[pillar\]|pillar copy| copy|\(copy\)')),
hf AS (SELECT url, 'multi_h1' AS class, {fp("'heading_structure'", "'multi_h1'", 'url')} AS fingerprint, 'warning' AS severity FROM o WHERE level = 1 GROUP BY url HAVING count(*) > 1
UNION ALL SELECT url, 'empty', {fp("'heading_structure'", "'empty'", 'url', "'H' || level")}, 'warning' FROM o WHERE trim(text) = ''
UNION ALL SELECT url, 'skipped', {fp("'heading_structure'", "'skipped'", 'url', "'H' || prev || '->H' || level", 'text')}, 'info' FROM l WHERE level > prev + 1
UNION ALL SELECT url, 'label_leak', {fp("'heading_structure'", "'label_leak'", 'url', "'H' || level || CASE WHEN nth = 0 THEN '' ELSE '#' || nth END", 'text')}, 'error' FROM lk)"""


@query(f"WITH {MP_SQL}, {HEADINGS_SQL} SELECT * FROM hf")
def r2_headings(spark, sf):
    return page_rules.check_headings(made_parsed(spark, sf)).select(*RULE_COLUMNS)


WORD_RULE = mining.OPENED_WORD.replace("'", "''")
STEMS_SQL = ", ".join(
    f"CASE WHEN ends_with(part, '{e}') AND length(part) >= {len(e) + 3} {more} THEN {form} END".replace("{stem}", f"left(part, length(part) - {len(e)})").replace("{short}", f"left(part, length(part) - {len(e) + 1})")
    for e in (x.replace("'", "''") for x in mining.ENDINGS if "'" not in x)
    for more, form in (("", "{stem}"), ("", "{stem} || 'e'"), ("AND right({stem}, 1) = 'i'", "{short}"), ("AND right({stem}, 1) = 'i'", "{short} || 'y'"))
)


@query(f"""WITH {MP_SQL}, vp AS (SELECT url || '/' || replace(title, ' ', '-') AS url, coalesce(brand, '') AS brand, vis, title, descr FROM mp),
sf AS (SELECT url, brand, 0 AS turn, 'page text' AS location, vis AS t FROM vp UNION ALL SELECT url, brand, 1, 'search-result title', title FROM vp UNION ALL SELECT url, brand, 2, 'search-result description', descr FROM vp),
rw AS (SELECT url, brand, turn, location, unnest(regexp_extract_all(t, '{WORD_RULE}')) AS raw FROM sf), ow AS (SELECT *, regexp_replace(raw, '^[^A-Za-z]+|[''-]+$', '', 'g') AS o FROM rw),
se AS (SELECT DISTINCT url, brand, turn, location, lower(o) AS word FROM ow WHERE regexp_matches(o, '^[a-z][a-z''-]{{3,}}$') OR (regexp_matches(o, '^[A-Z][a-z''-]{{3,}}$') AND NOT regexp_matches(raw, '^[A-Z]'))
  UNION SELECT url, brand, -1, 'page address', unnest(regexp_extract_all(lower(regexp_extract(rtrim(url, '/'), '[^/]*$')), '[a-z]{{4,}}')) FROM vp),
di AS (SELECT token, count(*) AS freq FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{{3,}}')) AS token FROM benchmark) GROUP BY token),
li AS (SELECT token FROM di UNION SELECT unnest([lower(r_name)] || list_filter(string_split(lower(r_name), ' '), lambda x: length(x) >= 3)) FROM region),
br AS (SELECT DISTINCT brand, unnest(regexp_extract_all(lower(brand || ' ' || regexp_extract(url, '^[^:]*://[^/?#]*')), '[a-z]{{3,}}')) AS token FROM vp), wo AS (SELECT DISTINCT brand, word FROM se),
pa AS (SELECT brand, word, unnest(CASE WHEN contains(word, '-') THEN list_filter(string_split(word, '-'), lambda x: length(x) >= 4) ELSE [word] END) AS part FROM wo),
fo AS (SELECT brand, word, part, unnest([part, {STEMS_SQL}]) AS token FROM pa), ok AS (SELECT brand, word, part FROM fo WHERE token IN (SELECT token FROM li) OR (brand, token) IN (SELECT brand, token FROM br)),
ba AS (SELECT DISTINCT brand, word FROM pa WHERE (brand, word, part) NOT IN (SELECT brand, word, part FROM ok) AND word NOT IN (SELECT token FROM li)),
ne AS (SELECT word, token, freq, damerau_levenshtein(word, token) AS far FROM (SELECT DISTINCT word FROM ba) JOIN di ON abs(length(word) - length(token)) <= 2 WHERE damerau_levenshtein(word, token) <= 2),
fx AS (SELECT word, token AS fix FROM ne QUALIFY row_number() OVER (PARTITION BY word ORDER BY far, freq DESC, token) = 1),
nm AS (SELECT se.*, row_number() OVER (PARTITION BY url, word, turn < 0 ORDER BY turn) - 1 AS nth FROM se JOIN ba USING (brand, word)),
cl AS (SELECT *, CASE WHEN turn < 0 THEN 'slug' WHEN nth = 0 THEN 'word' ELSE 'word#' || nth END AS class FROM nm)
SELECT url, class, {fp("'spelling'", 'class', 'url', 'word')} AS fingerprint, CASE WHEN turn < 0 THEN 'error' ELSE 'warning' END AS severity, location, word AS matched, fix FROM cl LEFT JOIN fx USING (word)""")
def r12_vocabulary(spark, sf):
    """The benchmark's words are the dictionary, names of regions the allow list; an address ends in the words of the title."""
    p = made_parsed(spark, sf).withColumn("url", F.concat("url", F.lit("/"), F.translate("title", " ", "-")))
    heard = table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))).alias("token"))
    names = table(spark, sf, "region").select(F.col("r_name").alias("token"))
    counted = heard.groupBy("token").agg(F.count("*").alias("freq"))
    p = kept(p.select("url", "brand", "visible_text", "title", "meta_description"), "read")
    unknown = kept(mining.unexplained_words(p, counted, names, keep=kept), "unknown")
    judged = kept(mining.with_fixes(unknown, counted), "judged")
    return mining.vocabulary_findings(p, counted, names, judged).select("url", "class", "fingerprint", "severity", "location", "matched", "fix")


@query(f"WITH {MP_SQL} " + _kind(0, "placeholder", "lorem_ipsum", "error") + " UNION ALL " + _kind(0, "placeholder", "shortcode", "error", "'[some_calculator]'"))
def r4_placeholder(spark, sf):
    return page_rules.check_placeholder(made_parsed(spark, sf)).select(*RULE_COLUMNS)


@query(f"WITH {MP_SQL} " + _kind(0, "empty_slot", "lorem_ipsum", "error", "'lorem'"))
def r8_lorem_page(spark, sf):
    return page_rules.check_lorem_page(made_parsed(spark, sf)).select(*RULE_COLUMNS)


@query(f"WITH {MP_SQL} " + _kind(10, "scope", "county_for_country", "error", "'across the county'"))
def r11_scope(spark, sf):
    return page_rules.check_scope(made_parsed(spark, sf)).select(*RULE_COLUMNS)


@query(f"WITH {MP_SQL} " + _kind(8, "actions", "dead_cta", "error", "'view more'"))
def r13_dead_cta(spark, sf):
    return page_rules.check_dead_cta(made_parsed(spark, sf)).select(*RULE_COLUMNS)


@query(f"WITH {MP_SQL} " + _kind(9, "actions", "social_misrouted", "error", "'instagram->facebook'"))
def r14_social(spark, sf):
    return page_rules.check_social_misrouted(made_parsed(spark, sf)).select(*RULE_COLUMNS)


@query(f"WITH {MP_SQL} " + _kind(11, "duplication", "duplicate_link", "warning", "'same'", "'/a'"))
def r19_duplicate_link(spark, sf):
    return page_rules.check_duplicate_link(made_parsed(spark, sf)).select(*RULE_COLUMNS)


@query(f"WITH {MP_SQL} " + _kind(7, "empty_row", "empty_row", "warning", "'li'", "'one'"))
def r20_empty_group(spark, sf):
    return page_rules.check_empty_slot_group(made_parsed(spark, sf)).select(*RULE_COLUMNS)


@query(f"WITH {MP_SQL} " + " UNION ALL ".join(_kind(1, "markup", c, "error") for c in ("link-name", "label", "meta-viewport")))
def r22_markup(spark, sf):
    return page_rules.check_markup_access(made_parsed(spark, sf)).select(*RULE_COLUMNS)


@query(f"""WITH {MP_SQL}, n AS (SELECT url, trim(regexp_replace(para, '\\s+', ' ', 'g')) AS norm FROM mp WHERE k = 6 AND length(para) >= 120 AND len(w) >= 18)
SELECT url, 'duplicate_paragraph' AS class, {fp("'duplication'", "'duplicate_paragraph'", 'url', 'substr(sha1(norm), 1, 16)')} AS fingerprint, 'warning' AS severity FROM n""")
def r18_duplicate_paragraph_parsed(spark, sf):
    return page_rules.check_duplicate_paragraph(page_rules.body_blocks(made_parsed(spark, sf))).select(*RULE_COLUMNS)


@query(f"""WITH {MP_SQL} SELECT doc_id, title, descr AS meta_description, k = 5 AS is_noindex, sha1(vis) AS text_sha1, sha256(html) AS content_hash, CAST(len(headings) AS INT) AS n_headings,
  CAST(1 + CASE WHEN k IN (1, 9, 11) THEN 1 ELSE 0 END AS INT) AS n_links, CAST(1 + CASE k WHEN 1 THEN 1 WHEN 8 THEN 1 WHEN 9 THEN 1 WHEN 11 THEN 2 ELSE 0 END AS INT) AS n_actionables,
  CAST(3 + CASE k WHEN 5 THEN 0 WHEN 7 THEN 5 WHEN 11 THEN 2 ELSE 1 END AS INT) AS n_blocks, CAST(CASE WHEN k = 1 THEN 1 ELSE 0 END AS INT) AS unlabelled_fields, CAST(NULL AS VARCHAR) AS error FROM mp""")
def x_extract(spark, sf):
    count = lambda c: F.size(c).alias(f"n_{c}")
    p = made_parsed(spark, sf)
    return p.select("doc_id", "title", "meta_description", "is_noindex", F.sha1(F.col("visible_text").cast("binary")).alias("text_sha1"), "content_hash", count("headings"), count("links"), count("actionables"), count("blocks"), "unlabelled_fields", "error")


@query(f"""WITH {MP_SQL}, r AS (SELECT *, 'https://' || coalesce(brand, 'none') || '.example.com' AS root FROM mp)
SELECT url, title, descr AS meta_description, k = 5 AS is_noindex, sha256(html) AS content_hash, title AS h1_text, CAST(length(vis) AS INT) AS visible_chars,
  root || '/' || CASE k WHEN 1 THEN ' ' || root || '/x' WHEN 9 THEN ' https://www.facebook.com/x' WHEN 11 THEN ' ' || root || '/a' ELSE '' END AS link_urls FROM r""")
def x13_projection(spark, sf):
    return extract.to_projection(made_parsed(spark, sf)).withColumn("link_urls", F.array_join("link_urls", " "))


@query(f"WITH {MP_SQL} SELECT url, sha1(array_to_string(list_filter([title, CASE k WHEN 2 THEN trim(title || ' (copy)') WHEN 3 THEN 'deep' ELSE '' END, para, CASE k WHEN 0 THEN '[some_calculator] lorem ipsum dolor' WHEN 6 THEN para WHEN 7 THEN 'one' || chr(10) || 'three' || chr(10) || 'four' || chr(10) || 'five' WHEN 8 THEN 'View more' WHEN 10 THEN 'Serving across the county today' WHEN 11 THEN 'Same' || chr(10) || 'Same' ELSE '' END], lambda x: x <> ''), chr(10))) AS body_sha1 FROM mp WHERE para <> ''")
def x10_body_text(spark, sf):
    p = made_parsed(spark, sf).withColumn("body", extract.body_text())
    return p.where("exists(blocks, b -> b.tag = 'p' and b.text <> '')").where("title <> ''").select("url", F.sha1(F.col("body").cast("binary")).alias("body_sha1"))


@query(f"""WITH {MP_SQL}, s AS (SELECT url, coalesce(w[1], 'x') AS section FROM mp WHERE k = 2)
SELECT section, 2 AS depth, count(DISTINCT url) AS page_count, min(url) AS url FROM s GROUP BY section HAVING count(DISTINCT url) >= 2""")
def a5_collapse_headings(spark, sf):
    return collapse.collapse_headings(page_rules.check_headings(made_parsed(spark, sf)))


@query(f"""WITH {MP_SQL} SELECT url, 'dead_cta' AS class, 'html>body>p:nth-of-type(2)>a' AS selector FROM mp WHERE k = 8 AND length(title) % 2 = 1""")
def f13_locatable(spark, sf):
    p = made_parsed(spark, sf)
    status = F.when(F.length("title") % 2 == 1, "new").otherwise("resolved")
    found = page_rules.check_dead_cta(p).join(p.select("url", status.alias("status")), "url")
    return serving.locatable_targets(found.withColumn("selector", F.col("matched")), ("dead_cta",))


MF_SQL = f"""{MP_SQL}, {HEADINGS_SQL}, mf AS (SELECT 'heading_structure' AS check_, class, url, fingerprint, CAST(NULL AS VARCHAR) AS matched FROM hf
  UNION ALL SELECT 'placeholder', class, url, fingerprint, CASE class WHEN 'shortcode' THEN '[some_calculator]' END FROM ({_kind(0, "placeholder", "lorem_ipsum", "error")} UNION ALL {_kind(0, "placeholder", "shortcode", "error", "'[some_calculator]'")})
  UNION ALL SELECT 'actions', class, url, fingerprint, 'html>body>p:nth-of-type(2)>a' FROM ({_kind(8, "actions", "dead_cta", "error", "'view more'")})
  UNION ALL SELECT 'empty_row', class, url, fingerprint, NULL FROM ({_kind(7, "empty_row", "empty_row", "warning", "'li'", "'one'")})),
ms AS (SELECT mf.*, brand, CASE WHEN length(title) % 5 = 0 THEN 'rule_changed' ELSE 'new' END AS status FROM mf JOIN mp ON mf.url = mp.url)"""


def made_findings(spark, sf):
    p = kept(made_parsed(spark, sf), "parsed")
    found = page_rules.union(page_rules.check_headings(p), page_rules.check_placeholder(p), page_rules.check_dead_cta(p), page_rules.check_empty_slot_group(p))
    return found.join(p.select("url", "brand", F.when(F.length("title") % 5 == 0, "rule_changed").otherwise("new").alias("status")), "url")


ERRORS = "class IN ('label_leak', 'lorem_ipsum', 'shortcode', 'dead_cta')"


@query(f"""WITH {MF_SQL} SELECT fingerprint, length(url) AS page_count FROM ms WHERE status = 'new' AND {ERRORS} ORDER BY page_count DESC, fingerprint LIMIT 20""")
def t6_digest(spark, sf):
    found = made_findings(spark, sf).withColumn("page_count", F.length("url").cast("long"))
    return serving.new_error_digest(found).select("fingerprint", "page_count")


@query(f"""WITH {MF_SQL} SELECT count(*) AS untriaged, 31 - min(length(url) % 5) AS oldest_days FROM ms WHERE status = 'new' AND {ERRORS} AND length(url) % 2 = 0""")
def t7_untriaged(spark, sf):
    n = F.length("url")
    found = made_findings(spark, sf).withColumns({"state": F.when(n % 2 == 0, "open").otherwise("wontfix"), "first_seen": F.concat(F.lit("2024-01-0"), (n % 5 + 1).cast("string"))})
    out = serving.untriaged_summary(found, F.lit("2024-02-01").cast("date"))
    return out.withColumn("oldest_days", F.col("oldest_days").cast("long"))


@query(f"""WITH {MF_SQL}, r AS (SELECT *, CASE WHEN {ERRORS} THEN 0 WHEN class = 'skipped' THEN 2 ELSE 1 END AS severity, CASE length(url) % 3 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 3 END AS state, '2024-01-0' || (length(url) % 5 + 1) AS seen FROM ms)
SELECT fingerprint, row_number() OVER (ORDER BY state, severity, seen, sha256(fingerprint)) AS place FROM r QUALIFY place <= 50""")
def t3_triage_order(spark, sf):
    """The first fifty in the order of triage, numbered."""
    n = F.length("url")
    state = F.when(n % 3 == 0, "open").when(n % 3 == 1, "wontfix").otherwise("fixed")
    found = made_findings(spark, sf).withColumns({"state": state, "first_seen": F.concat(F.lit("2024-01-0"), (n % 5 + 1).cast("string")), "fingerprint_hash": T.fp_hash(F.col("fingerprint"))})
    top = serving.triage_order(found.select("fingerprint", "severity", "state", "first_seen", "fingerprint_hash")).limit(50)
    return top.groupBy().agg(F.collect_list("fingerprint").alias("f")).select(F.posexplode("f").alias("place", "fingerprint")).select("fingerprint", (F.col("place") + 1).cast("long").alias("place"))


@query(f"""WITH {MF_SQL}, g AS (SELECT brand, count(*) FILTER (status = 'new') AS open, count(*) FILTER (status = 'new' AND (check_ = 'actions' OR class = 'multi_h1')) AS "new", count(*) FILTER (status <> 'new') AS carried FROM ms GROUP BY brand)
SELECT *, round(100.0 * "new" / greatest(open, 1), 1) AS percent FROM g""")
def a24_new_check_share(spark, sf):
    return serving.new_check_share(made_findings(spark, sf), ("actions",), {"heading_structure": ("multi_h1",)})


@query(f"""WITH {MF_SQL}, t AS (SELECT brand, check_ || '/' || class AS name, count(*) AS n, count(DISTINCT coalesce(matched, class)) AS shapes, count(DISTINCT url) AS pages FROM ms WHERE status = 'new' GROUP BY brand, check_ || '/' || class),
r AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY n DESC, name) AS rn FROM t) SELECT brand, name, n, CASE WHEN name = 'heading_structure/skipped' THEN 1 ELSE shapes END AS shapes, pages, n > 100 AS one_template FROM r WHERE rn = 1""")
def a24_concentration(spark, sf):
    return serving.template_concentration(made_findings(spark, sf))


@query(f"""WITH {MF_SQL} SELECT brand, count(*) AS findings, CAST(sum(length(class)) AS BIGINT) AS pages FROM ms WHERE status = 'new' AND class IN ('label_leak', 'shortcode') GROUP BY brand""")
def a24_family(spark, sf):
    found = made_findings(spark, sf).withColumn("page_count", F.length("class"))
    return serving.corruption_family(found, ("label_leak", "shortcode"))


@query(f"""WITH {MF_SQL}, miss AS (SELECT url FROM mp WHERE length(title) % 3 = 0) SELECT ms.fingerprint FROM ms WHERE check_ IN ('heading_structure', 'placeholder') AND url IN (SELECT url FROM miss)""")
def f12_added_pages(spark, sf):
    p = made_parsed(spark, sf)
    missing = p.where(F.length("title") % 3 == 0).select("url", F.lit("enumeration").alias("check"), F.lit("indexable_unsitemapped").alias("class"), F.concat(F.lit("missing:"), "url").alias("fingerprint"))
    return serving.on_added_pages(made_findings(spark, sf).select("url", "check", "class", "fingerprint").unionByName(missing)).select("fingerprint")


@query(f"""WITH {MP_SQL} SELECT 'visible_chars' AS what, CAST(sum(length(vis) + CASE WHEN k = 5 THEN 27 ELSE 0 END) AS BIGINT) AS before, CAST(sum(length(vis)) AS BIGINT) AS after FROM mp
UNION ALL SELECT 'lorem_page', count(*) FILTER (k IN (0, 5)), count(*) FILTER (k = 0) FROM mp UNION ALL SELECT 'placeholder', 2 * count(*) FILTER (k = 0) + count(*) FILTER (k = 5), 2 * count(*) FILTER (k = 0) FROM mp
UNION ALL SELECT 'blank', count(*) FILTER (length(vis) + CASE WHEN k = 5 THEN 27 ELSE 0 END < 500), count(*) FILTER (length(vis) < 500) FROM mp UNION ALL SELECT 'scope', count(*) FILTER (k = 10), count(*) FILTER (k = 10) FROM mp""")
def a30_hidden_text(spark, sf):
    return mining.hidden_text_impact(made_pages(spark, sf), ("lorem_page", "placeholder", "blank", "scope"), kept)


WRONG = ", ".join(f"'{w}'" for w in [*SITE_MISTAKES, "heath"])


@query(f"""WITH {MP_SQL}, c AS (SELECT *, len(list_filter(w[1:5], lambda x: list_contains([{WRONG}], x))) AS in_title, len(list_filter(w, lambda x: list_contains([{WRONG}], x))) AS in_para FROM mp)
SELECT brand, count(*) AS pages, count(*) FILTER (w[1] IN ({", ".join(f"'{w}'" for w in SITE_MISTAKES)})) AS slug_hits,
  CAST(sum(in_title * (1 + (k = 2)::INT) + in_para * (1 + (k = 6)::INT)) AS BIGINT) AS body_hits, count(*) FILTER (k = 10) AS scope_pages FROM c GROUP BY brand""")
def a31_defect_sweep(spark, sf):
    p = kept(made_parsed(spark, sf), "parsed")
    return mining.known_defect_sweep(p, SITE_MISTAKES, {"heath": "health"})


@query(f"""WITH {MP_SQL} SELECT 'blank:thin:' || url AS fingerprint, CASE WHEN k % 2 = 0 THEN 'low' ELSE 'normal' END AS confidence FROM mp WHERE length(vis) < 500
UNION ALL SELECT {fp("'meta'", "'missing_desc'", 'url')}, 'normal' FROM mp WHERE descr = ''""")
def f10_confidence(spark, sf):
    p = made_parsed(spark, sf)
    found = page_rules.union(page_rules.check_blank(p), page_rules.check_meta(p).where("class = 'missing_desc'"))
    css = made_pages(spark, sf).select("url", F.when(F.col("k") % 2 == 0, "partial").otherwise("ok").alias("css_status"))
    return page_rules.with_confidence(found, css).select("fingerprint", "confidence")


@query(f"""WITH {MP_SQL} SELECT url, 'dead_cta' AS class, 'View more' AS label FROM mp WHERE k = 8""")
def v16_details(spark, sf):
    """Details as one JSON text of a finding, read back by key."""
    found = page_rules.check_dead_cta(made_parsed(spark, sf)).withColumn("details", F.to_json(F.struct("class", F.col("snippet").alias("label"))))
    return found.select("url", T.detail(F.col("details"), "class").alias("class"), T.detail(F.col("details"), "label").alias("label"))


@query()
def st1_findings_stream(spark, sf):
    """All page rules over a stream of pages; tests hold it against the same rules in one batch."""
    landed, out, errors = shared_folder(spark, "landed"), shared_folder(spark, "found"), shared_folder(spark, "errors")
    pages = made_pages(spark, sf).select("url", "html")
    pages.write.parquet(landed)
    stream = incremental.read_page_stream(spark, landed, "url string, html string")
    incremental.audit_batches(stream, out, errors, shared_folder(spark, "ck")).awaitTermination()
    return spark.read.schema("url string, check string, class string, fingerprint string, severity string").parquet(out)


assert HOST
