"""Cross-page analyses: duplicates, collapsing of template-wide repeats, patterns of sources, rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siftwell.functions import text as T

TEMPLATE_CHECKS = ("duplication", "empty_row", "actions", "empty_slot", "misspelling", "scope")  # fixed values
SAMPLE = 8


SALTS = 64


def first_of(df: DataFrame, key: list[str], value: str, most: int, out: str) -> DataFrame:
    """``key`` and the first ``most`` distinct values in order.

    Ranks inside salted parts of a key leave a few rows of each part, ranks over those the rest: a key that
    nearly all rows have is sorted by many tasks and gathered by none.
    """
    part = W.partitionBy(*key, "_salt").orderBy(value)
    salted = df.select(*key, value).distinct().withColumn("_salt", F.pmod(F.xxhash64(value), F.lit(SALTS)))
    few = salted.withColumn("_rn", F.row_number().over(part)).where(F.col("_rn") <= most)
    ranked = few.withColumn("_rn", F.row_number().over(W.partitionBy(*key).orderBy(value))).where(F.col("_rn") <= most)
    return ranked.groupBy(*key).agg(F.array_sort(F.collect_list(value)).alias(out))


def dup_across_pages(pages: DataFrame, order: str = "page_id", fields: tuple[str, ...] = ("title", "meta_description", "h1_text")) -> DataFrame:
    """Equal titles, descriptions or first headings on several pages: field, value, n_pages (true), url (first page), sources (sample), pattern (null: none fits exactly)."""
    each = pages.select("url", F.col(order).alias("pos"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lower(F.trim(F.coalesce(f, F.lit("")))).alias("value")) for f in fields])).alias("v"))
    each = each.select("url", "pos", "v.*").where("value <> ''")
    groups = each.groupBy("field", "value").agg(F.count_distinct("url").alias("n_pages"), F.min_by("url", F.struct("pos", "url")).alias("url")).where("n_pages > 1")
    hit = each.join(groups.select("field", "value"), ["field", "value"], "left_semi")
    sample = first_of(hit, ["field", "value"], "url", SAMPLE, "sources")
    finding = F.sha2(F.concat_ws(":", "field", "value"), 256).alias("finding")
    pattern = source_pattern(hit.select(finding, "url"), pages.select("url"))
    return groups.join(sample, ["field", "value"]).withColumn("finding", finding).join(pattern, "finding", "left").drop("finding")


def dedupe_findings(found: DataFrame, content: tuple[str, ...] = ("url", "class", "severity", "issue", "snippet", "matched")) -> DataFrame:
    """Equal repeats become one row; rows that share a fingerprint but differ all stay, with ``collision`` set."""
    hashed = found.withColumn("_content", F.xxhash64(*content))
    once = hashed.withColumn("_rn", F.row_number().over(W.partitionBy("fingerprint", "_content").orderBy("url"))).where("_rn = 1")
    sizes = hashed.groupBy("fingerprint").agg((F.min("_content") != F.max("_content")).alias("collision"))
    return once.join(sizes, "fingerprint").drop("_content", "_rn")


def collapse_phone(found: DataFrame) -> DataFrame:
    """Findings of class retired, unknown or non_canonical: one per class and number, with all pages counted."""
    site_wide = F.col("class").isin("retired", "unknown", "non_canonical")
    grouped = found.where(site_wide).groupBy("class", F.col("matched").alias("number")).agg(F.count_distinct("url").alias("page_count"), F.min("url").alias("url"), F.min_by("severity", T.severity_rank(F.col("severity"))).alias("severity"))
    kept = found.where(~site_wide).select("class", F.col("matched").alias("number"), F.lit(1).cast("long").alias("page_count"), "url", "severity")
    return grouped.unionByName(kept)


def phone_sources(found: DataFrame) -> DataFrame:
    """class, number, url: every page of every collapsed number, as rows, since a number of the footer is on all pages."""
    site_wide = F.col("class").isin("retired", "unknown", "non_canonical")
    return found.where(site_wide).select("class", F.col("matched").alias("number"), "url").distinct()


def collapse_repeats(found: DataFrame, least_pages: int = 3, checks: tuple[str, ...] = TEMPLATE_CHECKS) -> DataFrame:
    """One template finding for each shape on ``least_pages`` pages or more; rarer ones stay as they are.

    The shape is the match with digits as N, so "within 25" and "within 30" are one defect.
    """
    base = F.regexp_replace("class", r"#\d+$", "")
    shaped = found.withColumn("shape", F.when(F.col("check").isin(*checks), T.shape(F.coalesce(F.nullif("matched", F.lit("")), "snippet", F.lit(""))))).withColumn("base", base)
    sizes = shaped.where("shape is not null").groupBy("check", "base", "shape").agg(F.count_distinct("url").alias("page_count"), F.min("url").alias("first_url"), F.min_by("severity", T.severity_rank(F.col("severity"))).alias("sev")).where(F.col("page_count") >= least_pages)
    template = sizes.select(
        F.col("first_url").alias("url"), "check", F.col("base").alias("class"), T.fingerprint(F.col("check"), F.col("base"), "template", F.col("shape")).alias("fingerprint"),
        F.col("sev").alias("severity"), "page_count", F.lit(True).alias("template_wide"),
    )
    rest = shaped.join(sizes.select("check", "base", "shape"), ["check", "base", "shape"], "left_anti")
    return template.unionByName(rest.select("url", "check", "class", "fingerprint", "severity", F.lit(1).cast("long").alias("page_count"), F.lit(False).alias("template_wide")))


def collapse_headings(found: DataFrame, least_pages: int = 2) -> DataFrame:
    """Pages with several H1 by (first path segment, depth): one finding a section from two pages on."""
    sections = found.where("class = 'multi_h1'").groupBy(T.first_segment(F.col("url")).alias("section"), T.depth(F.col("url")).alias("depth"))
    return sections.agg(F.count_distinct("url").alias("page_count"), F.min("url").alias("url")).where(F.col("page_count") >= least_pages)


def rare_brand_mentions(found: DataFrame, n_pages: Column | int, share: float = 0.02, most: int = 25, least_audited: int = 50) -> DataFrame:
    """Mentions of another brand that are rare enough to be slips; nothing where too few pages were audited."""
    sums = found.groupBy("matched").agg(F.count_distinct("url").alias("pages"))
    audited = n_pages if isinstance(n_pages, Column) else F.lit(n_pages)
    rare = sums.where((audited >= least_audited) & (F.col("pages") <= most) & (F.col("pages") <= audited * share))
    return found.join(rare.select("matched"), "matched", "left_semi")


def _prefixes(url: Column) -> Column:
    """Scheme and host, then each deeper path prefix."""
    root = F.regexp_extract(url, r"^[^:]*://[^/]*", 0)
    parts = F.filter(F.split(F.regexp_replace(url, r"^[^:]*://[^/]*", ""), "/"), lambda s: s != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.when(i == 0, root).otherwise(F.concat_ws("/", root, F.slice(parts, F.lit(1), i))))


def source_pattern(affected: DataFrame, audited: DataFrame, key: str = "finding") -> DataFrame:
    """``key``, pattern: the deepest common prefix of its pages, where every audited page below it is affected; else null.

    ``affected``: key, url. ``audited``: url. Shallower prefixes only cover more pages, so trying the deepest is enough.
    """
    pages = affected.select(key, "url").distinct()
    each = pages.select(key, F.explode(_prefixes(F.col("url"))).alias("prefix"))
    sizes = pages.groupBy(key).agg(F.count("*").alias("n"))
    common = each.groupBy(key, "prefix").agg(F.count("*").alias("m")).join(sizes, key).where("m = n").groupBy(key).agg(F.max_by("prefix", F.length("prefix")).alias("prefix"), F.first("n").alias("n"))
    wanted = common.select("prefix").distinct()
    covered = audited.select("url").distinct().select(F.explode(_prefixes(F.col("url"))).alias("prefix")).join(wanted, "prefix").groupBy("prefix").agg(F.count("*").alias("covered"))
    exact = common.join(covered, "prefix", "left").withColumn("pattern", F.when((F.col("n") >= 2) & (F.col("covered") == F.col("n")), F.concat("prefix", F.lit("/*"))))
    return sizes.select(key).join(exact.select(key, "pattern"), key, "left")


def rollup(found: DataFrame) -> DataFrame:
    """Counts in total and by severity, check, check and severity, status: one pass of grouping sets."""
    status = found if "status" in found.columns else found.withColumn("status", F.lit("new"))
    one = lambda c: F.col(c)
    sets = [[], [one("severity")], [one("check")], [one("severity"), one("check")], [one("status")]]
    level = F.when(F.grouping_id() == 7, "total").when(F.grouping_id() == 3, "severity").when(F.grouping_id() == 5, "check").when(F.grouping_id() == 1, "check_severity").otherwise("status")
    counted = status.groupingSets(sets, "severity", "check", "status").agg(level.alias("level"), F.count("*").alias("n"))
    return counted.select("level", "severity", "check", "status", "n")


def sentence_blocks(texts: DataFrame, keep: tuple[str, ...] = ("brand", "url"), least: int = 40) -> DataFrame:
    """``texts``: ``keep`` and text, one row a page and ``keep`` its key. ``keep``, pos, start, text of each sentence of ``least`` characters or more.

    A line is a block, and blocks end before sentences do: a text is cut at line ends first and then behind ``.``, ``!`` or ``?``
    and white space. ``start`` is the code point, from 0, where the sentence stands; its white space is one space each.
    """
    ends = F.lit(r"(?U)\n|(?<=[.!?])[\s\x1c-\x1f&&[^\n]]+")
    parts = F.arrays_zip(F.split("text", ends).alias("part"), F.concat(F.regexp_extract_all("text", ends, F.lit(0)), F.array(F.lit(""))).alias("gap"))
    each = texts.select(*keep, F.posexplode(parts).alias("pos", "p")).select(*keep, "pos", F.col("p.part").alias("part"), F.col("p.gap").alias("gap"))
    before = W.partitionBy(*keep).orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    lead = F.length("part") - F.length(F.regexp_replace("part", r"(?U)^[\s\x1c-\x1f]+", ""))
    start = F.coalesce(F.sum(F.length("part") + F.length("gap")).over(before), F.lit(0)) + lead
    clean = F.trim(F.regexp_replace("part", r"(?U)[\s\x1c-\x1f]+", " "))
    return each.select(*keep, "pos", start.alias("start"), clean.alias("text")).where(F.length("text") >= least)


def boilerplate_share(blocks: DataFrame, share: float = 0.3, least_pages: int = 2, least_chars: int = 40) -> DataFrame:
    """``blocks``: brand, url, text. Per brand: pages, characters, share in blocks of many pages, share saved by storing each block once."""
    long = blocks.where(F.length("text") >= least_chars).select("brand", "url", F.sha1(F.col("text").cast("binary")).alias("block"), F.length("text").alias("chars"))
    pages = long.groupBy("brand").agg(F.count_distinct("url").alias("pages"), F.sum("chars").alias("chars"))
    sums = long.groupBy("brand", "block").agg(F.count_distinct("url").alias("on_pages"), F.sum("chars").alias("all_chars"), F.max("chars").alias("one"))
    joined = sums.join(pages, "brand")
    common = F.col("on_pages") >= F.greatest(F.lit(least_pages), F.ceil(F.col("pages") * share))
    return joined.groupBy("brand").agg(
        F.max("pages").alias("pages"), F.max("chars").alias("chars"),
        F.round(F.sum(F.when(common, F.col("all_chars")).otherwise(0)) / F.max("chars"), 6).alias("boilerplate"),
        F.round(1 - F.sum("one") / F.max("chars"), 6).alias("saving"),
    )


def unique_blocks(blocks: DataFrame, share: float = 0.3, least_pages: int = 2) -> DataFrame:
    """``blocks``: brand, url, pos, text. Blocks that are no boilerplate, once each, at their first place."""
    pages = blocks.groupBy("brand").agg(F.count_distinct("url").alias("pages"))
    sums = blocks.groupBy("brand", "text").agg(F.count_distinct("url").alias("on_pages"), F.min(F.struct("url", "pos")).alias("first")).join(pages, "brand")
    rare = sums.where(F.col("on_pages") < F.greatest(F.lit(least_pages), F.ceil(F.col("pages") * share)))
    return rare.select("brand", "first.url", "first.pos", "text")
