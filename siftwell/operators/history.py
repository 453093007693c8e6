"""Runs compared: statuses of findings, registry of pages, components, baselines, triage across runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

GLOBAL_COMPONENTS = ("parse", "crawl", "report")  # fixed values: a change of these moves every check


def changed_components(prior: DataFrame, current: DataFrame) -> DataFrame:
    """Both: component, value. Components that differ, appeared or went."""
    both = prior.select("component", F.col("value").alias("a")).join(current.select("component", F.col("value").alias("b")), "component", "full_outer")
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).select("component")


def diff_runs(prior: DataFrame, current: DataFrame, audited: DataFrame, live: DataFrame | None, changed_checks: DataFrame, now: str | None = None) -> DataFrame:
    """``prior``: fingerprint, url, check, first_seen. ``current``: fingerprint, url, check. ``audited``, ``live``: url. ``changed_checks``: check.

    New findings are first seen ``now``. Pages are the same with and without last slashes.

    One row per fingerprint of either run. Gone findings: page_removed or page_unsitemapped if their page was
    not audited (live known and without it, or not), else rule_changed if their check moved, else resolved.
    """
    p = prior.select("fingerprint", F.col("url").alias("p_url"), F.col("check").alias("p_check"), "first_seen")
    c = current.select("fingerprint", "url", "check", F.lit(True).alias("now"))
    both = p.join(c, "fingerprint", "full_outer").select("fingerprint", F.coalesce("url", "p_url").alias("url"), F.coalesce("check", "p_check").alias("check"), "first_seen", "now", F.col("p_url").isNotNull().alias("before"))
    page = lambda df, name: df.select(F.regexp_replace("url", "/+$", "").alias("_page")).distinct().withColumn(name, F.lit(True))
    both = both.withColumn("_page", F.regexp_replace("url", "/+$", "")).join(page(audited, "seen"), "_page", "left")
    if live is None:
        both = both.withColumn("alive", F.lit(True))
    else:
        both = both.join(page(live, "alive"), "_page", "left")
    both = both.join(changed_checks.select("check").distinct().withColumn("moved", F.lit(True)), "check", "left")
    status = (
        F.when(F.col("now") & F.col("before"), "persisting")
        .when(F.col("now"), "new")
        .when(F.col("seen").isNull() & F.col("alive").isNull(), "page_removed")
        .when(F.col("seen").isNull(), "page_unsitemapped")
        .when(F.col("moved"), "rule_changed")
        .otherwise("resolved")
    )
    return both.select("fingerprint", "url", "check", status.alias("status"), F.when(status == "new", F.lit(now)).otherwise(F.col("first_seen")).alias("first_seen"))


def checks_of_components(components: DataFrame, wiring: DataFrame) -> DataFrame:
    """``wiring``: component, check. Checks that changed components move; a global one moves all."""
    every = wiring.select("check").distinct()
    globally = components.where(F.col("component").isin(*GLOBAL_COMPONENTS)).limit(1)
    return components.join(wiring, "component").select("check").unionByName(every.join(globally.select(F.lit(1).alias("_x")), F.lit(True), "left_semi")).distinct()


def finding_history(findings: DataFrame, runs: DataFrame) -> DataFrame:
    """``findings``: run_id, fingerprint, status. ``runs``: run_id, started_at. Statuses in time with the one before; those of one run in order of their names."""
    order = W.partitionBy("fingerprint").orderBy("started_at", "run_id", "status")
    return findings.join(runs.select("run_id", "started_at"), "run_id").withColumn("previous", F.lag("status").over(order)).withColumn("turn", F.row_number().over(order))


def upsert_registry(registry: DataFrame, seen: DataFrame) -> DataFrame:
    """``registry``: brand, url, first_seen_run, last_seen_run. ``seen``: brand, url, run_id. One row a page: earliest kept, latest advanced."""
    both = registry.select("brand", "url", "first_seen_run", "last_seen_run").union(seen.select("brand", "url", "run_id", "run_id"))
    return both.groupBy("brand", "url").agg(F.min("first_seen_run").alias("first_seen_run"), F.max("last_seen_run").alias("last_seen_run"))


def latest_run_per_brand(runs: DataFrame) -> DataFrame:
    order = W.partitionBy("brand").orderBy(F.desc("started_at"), F.desc("run_id"))
    return runs.where("status = 'ok'").withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def baseline_run(runs: DataFrame, share: float = 0.7) -> DataFrame:
    """run_id, baseline: the newest earlier run of the brand with at least ``share`` of its pages."""
    r, e = runs.alias("r"), runs.alias("e")
    fits = (F.col("r.brand") == F.col("e.brand")) & (F.col("e.started_at") < F.col("r.started_at")) & (F.col("e.pages_audited") >= F.col("r.pages_audited") * share)
    pairs = r.join(e, fits, "left").groupBy("r.run_id").agg(F.max_by("e.run_id", F.struct("e.started_at", "e.run_id")).alias("baseline"))
    return pairs.select("run_id", "baseline")


def poisoned_baseline(runs: DataFrame, share: float = 0.7) -> DataFrame:
    """Reported runs whose previous reported run covered under ``share`` of their pages: run_id, previous, covered."""
    order = W.partitionBy("brand").orderBy("started_at", "run_id")
    reported = runs.where("report_dir is not null").withColumns({"previous": F.lag("run_id").over(order), "before": F.lag("pages_audited").over(order)})
    return reported.where(F.col("before") < F.col("pages_audited") * share).select("run_id", "previous", F.round(F.col("before") / F.col("pages_audited"), 6).alias("covered"))


def merge_triage(current: DataFrame, triage: DataFrame, rule_changed: DataFrame) -> DataFrame:
    """``current``: fingerprint, url, check. ``triage``: fingerprint, url, check, state, note, pos. ``rule_changed``: check.

    Decisions follow the fingerprint (first of repeats, blank ones never). An orphan decision whose check moved is
    noted once, on a finding of the same url and check that has none.
    """
    ranked = triage.where("fingerprint <> ''").withColumn("rn", F.row_number().over(W.partitionBy("fingerprint").orderBy("pos")))
    first = ranked.where("rn = 1").drop("rn")
    decided = current.join(first.select("fingerprint", "state", "note"), "fingerprint", "left")
    pair = W.partitionBy("url", "check")
    orphans = first.join(current.select("fingerprint"), "fingerprint", "left_anti").join(rule_changed.select("check").distinct(), "check", "left_semi")
    orphans = orphans.withColumn("k", F.row_number().over(pair.orderBy("pos"))).select("url", "check", "k", F.col("state").alias("was"))
    open_ones = decided.where("state is null").select("fingerprint", "url", "check").distinct().withColumn("k", F.row_number().over(pair.orderBy("fingerprint"))).select("fingerprint", "url", "check", "k")
    resets = open_ones.join(orphans, ["url", "check", "k"]).select("fingerprint", F.concat(F.lit("rule changed; was "), F.col("was")).alias("reset"))
    return decided.join(resets, "fingerprint", "left").select("fingerprint", "url", "check", F.coalesce("state", F.lit("open")).alias("state"), F.coalesce("note", "reset").alias("note"))


def upsert_triage(triage: DataFrame, decisions: DataFrame) -> DataFrame:
    """Both: brand, fingerprint_hash, state, note, updated_at. The last write of each key wins."""
    order = W.partitionBy("brand", "fingerprint_hash").orderBy(F.desc("updated_at"), F.desc("state"), F.desc("note"))
    return triage.unionByName(decisions).withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def attach_pass(found: DataFrame, earlier: DataFrame, existing: DataFrame) -> DataFrame:
    """``found``: brand, check, fingerprint. ``earlier``: brand, check, run_id, fingerprint, first_seen. ``existing``: fingerprint in the run.

    New or persisting against the latest earlier run of the same check; first_seen is carried; fingerprints the run has are skipped.
    """
    last = earlier.groupBy("brand", "check").agg(F.max("run_id").alias("run_id"))
    prior = earlier.join(last, ["brand", "check", "run_id"]).groupBy("brand", "check", "fingerprint").agg(F.min("first_seen").alias("first_seen"))
    fresh = found.join(existing.select("fingerprint").distinct(), "fingerprint", "left_anti")
    joined = fresh.join(prior.withColumn("old", F.lit(True)), ["brand", "check", "fingerprint"], "left")
    return joined.withColumn("status", F.when(F.col("old"), "persisting").otherwise("new")).drop("old")


def stale_passes(runs: DataFrame, findings: DataFrame, checks: tuple[str, ...]) -> DataFrame:
    """Brands whose latest complete run has no findings of a separately run check: brand, check, latest, run_id they sit on and how many (null: that check never ran)."""
    wanted = latest_run_per_brand(runs).select("brand", F.col("run_id").alias("latest"), F.explode(F.array(*map(F.lit, checks))).alias("check"))
    per_run = findings.where(F.col("check").isin(*checks)).groupBy("brand", "check", "run_id").agg(F.count("*").alias("findings"))
    met = wanted.join(per_run, ["brand", "check"], "left").groupBy("brand", "check", "latest")
    last = met.agg(F.max("run_id").alias("run_id"), F.max_by("findings", "run_id").alias("findings"), F.coalesce(F.bool_or(F.col("run_id") == F.col("latest")), F.lit(False)).alias("current"))
    return last.where("not current").drop("current")


def crawl_verdict(runs: DataFrame, least_ok: float = 0.5) -> DataFrame:
    """``runs``: run_id, enumerated, fetched, ok, blocked, from_cache. May the run be imported, and if not, why."""
    verdict = (
        F.when((F.col("enumerated") == 0) & (F.col("blocked") > 0), "refused_blocked")
        .when(F.col("enumerated") == 0, "refused_empty")
        .when((F.col("fetched") == 0) & (F.col("from_cache") > 0), "ok")
        .when(F.col("ok") < F.col("fetched") * least_ok, "refused_low_yield")
        .otherwise("ok")
    )
    return runs.withColumn("verdict", verdict)


def error_trend(runs: DataFrame, last: int = 14) -> DataFrame:
    """``runs``: brand, run_id, started_at, errors. The last settled runs, oldest first, scaled to the brand's own maximum."""
    recent = runs.withColumn("back", F.row_number().over(W.partitionBy("brand").orderBy(F.desc("started_at"), F.desc("run_id")))).where(F.col("back") <= last)
    top = F.max("errors").over(W.partitionBy("brand"))
    return recent.withColumn("scaled", F.round(F.when(top > 0, F.col("errors") / top).otherwise(0.0), 6))
