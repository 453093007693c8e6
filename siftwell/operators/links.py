"""The link graph and its rules: edges, classes without probing, probe window, probe results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siftwell.functions import text as T
from siftwell.operators.collapse import first_of

REFUSED = (400, 401, 402, 403, 406, 429, 999)  # fixed values: statuses by which other sites refuse a probe


def link_edges(projection: DataFrame) -> DataFrame:
    """url, target of every link; ``projection`` needs url and link_urls only, so links can be checked again without the pages."""
    return projection.select("url", F.explode("link_urls").alias("target")).where("target <> ''").distinct()


def sources_of(edges: DataFrame, stored: int = 5) -> DataFrame:
    """target, page_count (true), sources (first few by name), truncated.

    A target of the footer has every page as source: sources are counted and their first names kept
    by salted ranks, never gathered in full.
    """
    named = edges.groupBy("target").agg(F.count("*").alias("page_count"))
    return named.join(first_of(edges, ["target"], "url", stored, "sources"), "target").withColumn("truncated", F.col("page_count") > stored)


def moved_counts(counts: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """``counts``: target, page_count, as kept. ``old``, ``new``: link edges of the pages that were added, changed or removed, before and after. The counts after.

    Only the edges of these pages are read; a target that no page names any more goes. An edge that stays on a page moves nothing.
    """
    moves = new.select("target", F.lit(1).cast("long").alias("page_count")).unionByName(old.select("target", F.lit(-1).cast("long").alias("page_count")))
    net = moves.groupBy("target").agg(F.sum("page_count").alias("page_count")).where("page_count <> 0")
    return counts.select("target", "page_count").unionByName(net).groupBy("target").agg(F.sum("page_count").alias("page_count")).where("page_count > 0")


def link_class(target: Column, internal: Column) -> Column:
    """First class that fits; ``probe`` where only a request can tell; null for addresses that are no links at all."""
    return (
        F.when(target.contains("/cdn-cgi/"), F.lit(None).cast("string"))
        .when(T.is_malformed(target), "malformed")
        .when(T.has_embedded_scheme(target), "fused")
        .when(T.has_double_slash(target), "double_slash")
        .when(internal & T.is_cruft(target), "cruft")
        .when(internal & T.is_feed(target), "feed")
        .when(target.rlike(T.STAGING), "staging")
        .otherwise("probe")
    )


def link_severity(cls: Column) -> Column:
    return F.when(cls.isin("malformed", "fused", "cruft", "staging", "broken"), "error").when(cls.isin("double_slash", "feed", "transport_error"), "warning").when(cls.isin("redirected_internal", "unverified"), "info")


def classify_links(edges: DataFrame, sites: DataFrame) -> DataFrame:
    """``sites``: url, site (link domain of the page's brand). target, site, class, severity, page_count, sources, truncated."""
    with_site = edges.join(sites, "url")
    internal = T.link_domain(T.host(F.col("target"))) == F.col("site")
    classed = with_site.withColumn("class", link_class(F.col("target"), internal)).where("class is not null")
    one = classed.groupBy("target", "class").agg(F.min("site").alias("site"))
    return one.join(sources_of(edges), "target").withColumn("severity", link_severity(F.col("class")))


def relink(projection: DataFrame, sites: DataFrame) -> DataFrame:
    """The link rules over a stored projection (url, link_urls) alone: after a change of these rules no page is read or parsed again."""
    return classify_links(link_edges(projection.select("url", "link_urls")), sites)


def link_stats(classified: DataFrame) -> DataFrame:
    return classified.groupBy("class").agg(F.count("*").alias("targets"), F.sum("page_count").alias("links"))


def probe_window(targets: DataFrame, most: int, seed: int = 47802) -> DataFrame:
    """At most ``most`` targets: one of each (domain, first path segment) in turn, in seeded order inside it."""
    stratum = F.struct(T.link_domain(T.host(F.col("target"))).alias("h"), T.first_segment(F.col("target")).alias("s"))
    seeded = F.md5(F.concat(F.lit(f"{seed}:"), F.col("target")).cast("binary"))
    turn = F.row_number().over(W.partitionBy("stratum").orderBy("seeded", "target"))
    picked = targets.select("target").distinct().withColumns({"stratum": stratum, "seeded": seeded}).withColumn("turn", turn)
    return picked.orderBy("turn", "stratum.h", "stratum.s").limit(most).select("target").orderBy("target")


def classify_probes(results: DataFrame) -> DataFrame:
    """``results``: target, site, status (null: no answer), final_url. Class and severity of what is not fine."""
    internal = T.link_domain(T.host(F.col("target"))) == F.col("site")
    moved = F.rtrim(F.col("final_url"), F.lit("/")) != F.rtrim(F.col("target"), F.lit("/"))
    cls = (
        F.when(F.col("status").isNull(), "transport_error")
        .when(F.col("status").isin(*REFUSED) & ~internal, "unverified")
        .when(F.col("status") >= 400, "broken")
        .when(internal & moved, "redirected_internal")
    )
    return results.withColumn("class", cls).where("class is not null").withColumn("severity", link_severity(F.col("class")))


def sitemap_failures(fetches: DataFrame, share: float = 0.5) -> DataFrame:
    """``fetches``: brand, url, status. One finding a failed page, or one for the brand when ``share`` of its pages failed."""
    failed = F.col("status").isNull() | (F.col("status") >= 400)
    sums = fetches.groupBy("brand").agg(F.count("*").alias("pages"), F.count_if(failed).alias("failures"))
    mass = sums.where(F.col("failures") >= F.col("pages") * share)
    crawl = mass.select("brand", F.lit(None).cast("string").alias("url"), F.lit("crawl_incomplete").alias("class"), F.lit("error").alias("severity"), F.col("failures").cast("long").alias("n"))
    single = fetches.where(failed).join(mass.select("brand"), "brand", "left_anti")
    dead = single.select("brand", "url", F.when(F.col("status").isNull(), "sitemap_unreachable").otherwise("sitemap_dead").alias("class"), F.when(F.col("status").isNull(), "warning").otherwise("error").alias("severity"), F.lit(1).cast("long").alias("n"))
    return crawl.unionByName(dead)


def sitemap_reconcile(sitemap: DataFrame, listing: DataFrame) -> DataFrame:
    """Both: url. One row per canonical address with where it is known from."""
    a = sitemap.select(T.canonical_url(F.col("url")).alias("url")).distinct().withColumn("in_sitemap", F.lit(True))
    b = listing.select(T.canonical_url(F.col("url")).alias("url")).distinct().withColumn("in_listing", F.lit(True))
    return a.join(b, "url", "full_outer").select("url", F.coalesce("in_sitemap", F.lit(False)).alias("in_sitemap"), F.coalesce("in_listing", F.lit(False)).alias("in_listing"))


def missing_from_sitemap(live: DataFrame, sitemap: DataFrame) -> DataFrame:
    """``live``: url, is_noindex, fetched. Pages that exist and that the sitemap lacks, by what they are."""
    absent = live.join(sitemap.select(T.canonical_url(F.col("url")).alias("_u")).distinct(), T.canonical_url(F.col("url")) == F.col("_u"), "left_anti")
    cls = (
        F.when(~F.col("fetched"), "rest_404")
        .when(T.is_cruft(F.col("url")) & F.col("is_noindex"), "cruft_noindex")
        .when(T.is_cruft(F.col("url")), "cruft_indexable")
        .when(F.col("is_noindex"), "noindex_unsitemapped")
        .otherwise("indexable_unsitemapped")
    )
    severity = F.when(F.col("class") == "cruft_indexable", "error").when(F.col("class").isin("indexable_unsitemapped", "rest_404"), "warning").otherwise("info")
    return absent.withColumn("class", cls).withColumn("severity", severity).select("url", "class", "severity")


def audit_scope(sitemap: DataFrame, listing: DataFrame, static: DataFrame) -> DataFrame:
    """Each: pos, url. Sitemap order first, then the listing's; the static list only if both are empty."""
    parts = sitemap.select(F.lit(0).alias("rank"), "pos", "url").unionByName(listing.select(F.lit(1).alias("rank"), "pos", "url"))
    fallback = static.select(F.lit(2).alias("rank"), "pos", "url").join(parts.limit(1).select(F.lit(1).alias("_x")), F.lit(True), "left_anti")
    every = parts.unionByName(fallback).withColumn("url", T.canonical_url(F.col("url")))
    first = every.withColumn("rn", F.row_number().over(W.partitionBy("url").orderBy("rank", "pos"))).where("rn = 1")
    return first.select("url", "rank", "pos")


def scope_intersection(cached: DataFrame, scope: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``cached``, ``scope``: url. Cached rows whose page is still in scope, and those that are dropped."""
    canonical = scope.select(T.canonical_url(F.col("url")).alias("_u")).distinct()
    same = T.canonical_url(F.col("url")) == F.col("_u")
    return cached.join(canonical, same, "left_semi"), cached.join(canonical, same, "left_anti")


def difference_counts(sitemap: DataFrame, listing: DataFrame) -> DataFrame:
    """One row: pages of the sitemap, of the listing, of the listing alone (missing) and of the sitemap alone."""
    both = sitemap_reconcile(sitemap, listing)
    return both.agg(
        F.count_if("in_sitemap").alias("sitemap_total"), F.count_if("in_listing").alias("listing_total"),
        F.count_if(F.col("in_listing") & ~F.col("in_sitemap")).alias("missing"), F.count_if(F.col("in_sitemap") & ~F.col("in_listing")).alias("sitemap_only"),
    )


def off_brand(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``pages``: url, final_url. Pages that stay on their registrable domain, and findings for those that left it."""
    left = T.registrable(T.host(F.col("url"))) != T.registrable(T.host(F.coalesce("final_url", "url")))
    gone = pages.where(left).select("url", F.lit("redirects_off_brand").alias("class"), F.lit("info").alias("severity"), F.col("final_url").alias("matched"))
    return pages.where(~left), gone
