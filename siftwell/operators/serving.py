"""Reading findings: joins with triage, search, ranking, fair top lists, boards, digests, summaries, samples of pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siftwell.functions import text as T
from siftwell.operators.traffic import union_reach

OPEN = ("new", "persisting")  # fixed values
GONE = ("resolved", "rule_changed", "page_removed")
CARRIED = ("page_unsitemapped", "page_removed", "rule_changed")
MISSING_LIVE = ("indexable_unsitemapped", "noindex_unsitemapped", "cruft_noindex", "cruft_indexable")
PER_PAGE = ("heading_structure", "meta", "blank", "placeholder")
SITE_WIDE_PHONE = ("retired", "unknown", "non_canonical")
TRIAGE_ORDER = ("open", "in_progress", "wontfix", "fixed", "false_positive")
URL_LIST_CLASSES = ("enumeration:sitemap_dead", "enumeration:indexable_unsitemapped", "enumeration:noindex_unsitemapped", "enumeration:rest_404", "broken_links:unverified_external")


def is_open() -> Column:
    return F.col("status").isin(*OPEN)


def with_triage(found: DataFrame, triage: DataFrame) -> DataFrame:
    """Left join on (brand, fingerprint_hash); no row and ``open`` are the same state."""
    return found.join(triage.select("brand", "fingerprint_hash", "state", "note"), ["brand", "fingerprint_hash"], "left").withColumn("state", F.coalesce("state", F.lit("open")))


def search_findings(found: DataFrame, brand: str | None = None, check: str | None = None, severity: str | None = None, state: str | None = None, status: str | None = None, text: str | None = None) -> DataFrame:
    """``found``: with triage. Equality filters, and a substring of url, issue or snippet in any case."""
    out = found
    for name, value in (("brand", brand), ("check", check), ("severity", severity), ("state", state), ("status", status)):
        if value is not None:
            out = out.where(F.col(name) == value)
    if text:
        needle = F.lit(text.lower())
        out = out.where(F.contains(F.lower("url"), needle) | F.contains(F.lower("issue"), needle) | F.coalesce(F.contains(F.lower("snippet"), needle), F.lit(False)))
    return out


def rank_findings(found: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Severity, then pages affected, then newest. Keys are ranked alone; the rows of one page of results are joined after."""
    order = [T.severity_rank(F.col("severity")), F.desc("page_count"), F.desc("id")]
    if limit is None:
        return found.orderBy(*order)
    keys = found.select("id", "severity", "page_count").orderBy(*order).offset(offset).limit(limit).select("id")
    return found.join(keys, "id", "left_semi").orderBy(*order)


def triage_order(found: DataFrame) -> DataFrame:
    rank = F.lit(len(TRIAGE_ORDER))
    for i, s in reversed(list(enumerate(TRIAGE_ORDER))):
        rank = F.when(F.col("state") == s, i).otherwise(rank)
    return found.orderBy(rank, T.severity_rank(F.col("severity")), F.col("first_seen").asc_nulls_last(), "fingerprint_hash")


def select_shown(found: DataFrame, most: int) -> DataFrame:
    """Inside a severity one row of each class before a second; a severity is never passed over by a lower one."""
    sizes = found.groupBy("severity", "class").agg(F.sum("page_count").alias("class_pages"))
    inside = W.partitionBy("severity", "class").orderBy(F.desc("page_count"), "fingerprint")
    ranked = found.withColumn("rn", F.row_number().over(inside)).where(F.col("rn") <= most).join(sizes, ["severity", "class"])
    return ranked.orderBy(T.severity_rank(F.col("severity")), "rn", F.desc("class_pages"), "class").limit(most)


def section_rows(found: DataFrame, whole: tuple[str, ...] = URL_LIST_CLASSES) -> DataFrame:
    """``found``: with url, sources and page_count. Equal (check, class, issue, snippet) as one row; classes that are lists of addresses are one row each.

    Pages are a union of those the findings name, never a sum of counts where all are named. Severe rows first, then those on most pages.
    """
    listed = F.concat_ws(":", "check", "class").isin(*whole)
    keyed = found.withColumns({"i": F.when(listed, F.lit("")).otherwise(F.col("issue")), "s": F.when(listed, F.lit("")).otherwise(F.coalesce("snippet", F.lit("")))})
    key = ("check", "class", "i", "s")
    first = F.struct(T.severity_rank(F.col("severity")).alias("r"), (-F.coalesce("page_count", F.lit(1))).alias("p"), F.col("fingerprint"))
    sums = keyed.groupBy(*key).agg(F.min_by("severity", first).alias("severity"), F.count("*").alias("members"), F.min_by("fingerprint", first).alias("fingerprint"))
    spans = union_reach(keyed.select(*key, "url", "sources", "page_count"), key)
    rows = sums.join(spans, list(key)).select("check", "class", F.col("i").alias("issue"), "severity", F.col("pages").alias("page_count"), "members", "fingerprint")
    return rows.orderBy(T.severity_rank(F.col("severity")), F.desc("page_count"), "fingerprint")


def issue_wording(found: DataFrame, rules: DataFrame) -> DataFrame:
    """``rules``: rule_no, check, prefix, wording (tens of rows). The first rule whose check and issue prefix fit; a suggestion of its own wins."""
    fits = (F.col("r.check") == F.col("f.check")) & F.startswith("f.issue", "r.prefix")
    pairs = found.alias("f").join(rules.alias("r"), fits, "left")
    best = pairs.groupBy("f.fingerprint").agg(F.min_by("r.wording", "r.rule_no").alias("wording"))
    return found.join(best, "fingerprint").withColumn("wording", F.coalesce(F.nullif("suggestion", F.lit("")), "wording", "issue"))


def section_assign(found: DataFrame, sections: DataFrame) -> DataFrame:
    """``sections``: section_no, check, class (``*`` for any); tens of rows. Each finding goes to the first section that claims it."""
    base = F.regexp_replace("f.class", r"#\d+$", "")
    fits = (F.col("s.check") == F.col("f.check")) & ((F.col("s.class") == "*") | (F.col("s.class") == base))
    return found.alias("f").join(sections.alias("s"), fits, "left").groupBy("f.fingerprint").agg(F.min("s.section_no").alias("section_no"))


def brand_board(found: DataFrame, runs: DataFrame) -> DataFrame:
    """``found``: latest findings with triage. Per brand: last run, open findings by severity, untriaged errors."""
    from siftwell.operators.history import latest_run_per_brand

    counts = found.where(is_open()).groupBy("brand").agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in T.SEVERITIES], F.count_if((F.col("severity") == "error") & (F.col("state") == "open")).alias("untriaged_errors")
    )
    last = latest_run_per_brand(runs).select("brand", "run_id")
    return last.join(counts, "brand", "left").na.fill(0, [*T.SEVERITIES, "untriaged_errors"])


def check_facet(found: DataFrame) -> DataFrame:
    return found.where(is_open()).groupBy("check").agg(F.count("*").alias("n"))


def run_list(found: DataFrame) -> DataFrame:
    return found.groupBy("run_id").agg(F.count_if((F.col("severity") == "error") & is_open()).alias("open_errors"), F.count_if(F.col("status") == "new").alias("new"))


def health(brands: DataFrame, runs: DataFrame, found: DataFrame) -> DataFrame:
    """One row: how many brands, runs and findings there are."""
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n") for name, df in (("brands", brands), ("runs", runs), ("findings", found))]
    return counts[0].union(counts[1]).union(counts[2]).groupBy().pivot("what", ["brands", "runs", "findings"]).agg(F.first("n"))


def triage_age(first_seen: Column, today: Column) -> Column:
    """Whole days since a finding was first seen, 0 at least."""
    return F.greatest(F.date_diff(today, first_seen.cast("date")), F.lit(0))


def digest_line(brand: Column, new: Column, resolved: Column, open_: Column, untriaged: Column, oldest: Column) -> Column:
    """The line that says what moved and what nobody has looked at."""
    stale = F.when(untriaged == 0, "nothing untriaged").otherwise(F.concat(untriaged.cast("string"), F.when(untriaged == 1, " ERROR").otherwise(" ERRORs"), F.lit(" untriaged, oldest is "), oldest.cast("string"), F.lit(" days")))
    return F.concat(brand, F.lit(": "), new.cast("string"), F.lit(" new, "), resolved.cast("string"), F.lit(" fixed, "), open_.cast("string"), F.lit(" open — "), stale)


def new_error_digest(found: DataFrame, most: int = 20) -> DataFrame:
    return found.where("status = 'new' and severity = 'error'").orderBy(F.desc("page_count"), "fingerprint").limit(most)


def untriaged_summary(found: DataFrame, today: Column) -> DataFrame:
    """Number and largest age in days of open errors without a decision."""
    age = triage_age(F.col("first_seen"), today)
    return found.where(is_open() & (F.col("severity") == "error") & (F.col("state") == "open")).agg(F.count("*").alias("untriaged"), F.coalesce(F.max(age), F.lit(0)).alias("oldest_days"))


def run_summary(diffed: DataFrame) -> DataFrame:
    """``diffed``: brand, status. New, open, really resolved, moved by rules, pages gone."""
    return diffed.groupBy("brand").agg(
        F.count_if(is_open()).alias("open"), F.count_if(F.col("status") == "new").alias("new"), F.count_if(F.col("status") == "resolved").alias("resolved"),
        F.count_if(F.col("status") == "rule_changed").alias("rule_changed"), F.count_if(F.col("status").isin("page_removed", "page_unsitemapped")).alias("pages_gone"),
    )


def changes(diffed: DataFrame, registry: DataFrame | None = None, run: int | str | None = None, most: int = 200) -> DataFrame:
    """New and resolved rows, and pages that the ``registry`` (url, first_seen_run) first saw in ``run``, at most ``most`` of each."""
    out = []
    for status in ("new", "resolved"):
        out.append(diffed.where(F.col("status") == status).orderBy("fingerprint").limit(most).select(F.lit(status).alias("kind"), "fingerprint", "url"))
    if registry is not None:
        first = registry.where(F.col("first_seen_run") == run).select("url").distinct().orderBy("url").limit(most)
        out.append(first.select(F.lit("new_page").alias("kind"), F.lit(None).cast("string").alias("fingerprint"), "url"))
    return reduce(DataFrame.unionByName, out)


def on_added_pages(found: DataFrame) -> DataFrame:
    """``found``: url, check, class. Findings of single pages on pages that are live and that the sitemap lacks."""
    missing = found.where((F.col("check") == "enumeration") & F.col("class").isin(*MISSING_LIVE)).select("url").distinct()
    single = F.col("check").isin(*PER_PAGE) | ((F.col("check") == "phone") & ~F.col("class").isin(*SITE_WIDE_PHONE))
    return found.where(single).join(missing, "url", "left_semi")


def locatable_targets(found: DataFrame, classes: tuple[str, ...]) -> DataFrame:
    """``found``: url, fingerprint, status, selector. Distinct (url, class without its number, selector) of findings that are there."""
    cls = F.split_part(F.split_part("fingerprint", F.lit(":"), F.lit(2)), F.lit("#"), F.lit(1))
    there = found.where(~F.col("status").isin(*GONE) & (F.coalesce("selector", F.lit("")) != "") & (F.coalesce("url", F.lit("")) != ""))
    return there.select("url", cls.alias("class"), "selector").where(F.col("class").isin(*classes)).distinct()


def new_check_share(found: DataFrame, checks: tuple[str, ...], classes: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """``found``: brand, check, class, status. Per brand: open rows, those of new checks or classes, their share in percent, rows carried along."""
    new = F.col("check").isin(*checks)
    for check, names in (classes or {}).items():
        new = new | ((F.col("check") == check) & F.col("class").isin(*names))
    carried = F.col("status").isin(*CARRIED)
    sums = found.groupBy("brand").agg(F.count_if(~carried).alias("open"), F.count_if(~carried & new).alias("new"), F.count_if(carried).alias("carried"))
    return sums.withColumn("percent", F.round(100.0 * F.col("new") / F.greatest("open", F.lit(1)), 1))


def template_concentration(found: DataFrame) -> DataFrame:
    """``found``: brand, url, check, class, status, matched, issue. Per brand its largest class: rows, distinct shapes, pages, and whether it is one template."""
    there = found.where(~F.col("status").isin(*CARRIED))
    shape = F.lower(F.substring(F.regexp_replace(F.coalesce(F.nullif("matched", F.lit("")), "issue", F.lit("")), r"\d+", "N"), 1, 60))
    name = F.concat_ws("/", "check", "class")
    sums = there.groupBy("brand", name.alias("name")).agg(F.count("*").alias("n"), F.count_distinct(shape).alias("shapes"), F.count_distinct("url").alias("pages"))
    top = sums.groupBy("brand").agg(F.min_by(F.struct("name", "n", "shapes", "pages"), F.struct((-F.col("n")).alias("x"), F.col("name").alias("y"))).alias("t"))
    return top.select("brand", "t.*").withColumn("one_template", (F.col("shapes") <= 3) & (F.col("n") > 100))


def corruption_family(found: DataFrame, family: tuple[str, ...]) -> DataFrame:
    """``found``: brand, class, status, page_count. Per brand the findings of classes that one template field causes, and the pages they cover."""
    there = found.where(~F.col("status").isin(*CARRIED) & F.col("class").isin(*family))
    return there.groupBy("brand").agg(F.count("*").alias("findings"), F.sum(F.greatest(F.coalesce("page_count", F.lit(1)), F.lit(1))).alias("pages"))


def data_caveats(brands: DataFrame, runs: DataFrame) -> DataFrame:
    """``brands``: brand, fixed_list. ``runs``: brand, run_id, started_at, status, partial_sample, fixed_list. What to know before reading a brand's numbers.

    never: no run has ended. stale: the last that ended did not succeed, so the numbers are of an earlier one. in_flight: one is queued or running; it says
    nothing of the numbers yet. partial: the last that ended read a part of the site. fixed_list: pages come from a list kept by hand.
    """
    waiting = F.col("status").isin("queued", "running")
    last = F.max_by(F.when(~waiting, F.struct("status", "partial_sample", "fixed_list")), F.when(~waiting, F.struct("started_at", "run_id")))
    state = runs.groupBy("brand").agg(last.alias("last"), F.bool_or(waiting).alias("in_flight"))
    row = brands.select("brand", "fixed_list").join(state, "brand", "left")
    named = F.array_compact(F.array(
        F.when(F.col("last").isNull(), "never"), F.when(F.col("last.status") != "ok", "stale"), F.when(F.col("in_flight"), "in_flight"),
        F.when(F.col("last.partial_sample"), "partial"), F.when(F.coalesce("fixed_list", F.lit(False)) | F.coalesce("last.fixed_list", F.lit(False)), "fixed_list"),
    ))
    return row.select("brand", F.explode(named).alias("caveat"))


def seeded(url: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(url)).cast("binary"))


def sample_pages(pages: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """The same n pages each run, whatever the partitioning."""
    return pages.select("url").orderBy(seeded("url", seed), "url").limit(n).orderBy("url")


def stratified_round_robin(pages: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """One page of each section in turn, larger sections first."""
    by = pages.select("url", T.first_segment(F.col("url")).alias("section"))
    turn = F.row_number().over(W.partitionBy("section").orderBy(seeded("url", seed), "url"))
    sizes = by.groupBy("section").agg(F.count("*").alias("size"))
    return by.withColumn("turn", turn).where(F.col("turn") <= n).join(sizes, "section").orderBy("turn", F.desc("size"), "section").limit(n).select("url", "section")


def stratified_proportional(pages: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """Sections by their share, the second largest with one at least; what rounding leaves comes from the largest.

    Pages of a section are cut to ``n`` by rank before they meet the quotas; the total and the two largest sections are one row and two.
    """
    by = pages.select("url", T.first_segment(F.col("url")).alias("section"))
    sizes = by.groupBy("section").agg(F.count("*").alias("size"))
    top = sizes.orderBy(F.desc("size"), "section").limit(2)
    second = top.agg(F.when(F.count("*") == 2, F.max_by(F.struct("section"), F.struct(-F.col("size"), "section"))).alias("second"))
    total = sizes.agg(F.sum("size").alias("all"))
    quotas = sizes.join(total.join(second))  # one row each
    quota = F.greatest(F.floor(F.lit(n) * F.col("size") / F.col("all")), F.when(F.struct("section").eqNullSafe(F.col("second")), 1).otherwise(0))
    turn = F.row_number().over(W.partitionBy("section").orderBy(seeded("url", seed), "url"))
    few = by.withColumn("turn", turn).where(F.col("turn") <= n)
    picked = few.join(quotas.select("section", "size", quota.alias("quota")), few["section"].eqNullSafe(quotas["section"])).drop(quotas["section"])
    return picked.orderBy(F.col("turn") > F.col("quota"), F.desc("size"), "section", "turn").limit(n).select("url", "section")
