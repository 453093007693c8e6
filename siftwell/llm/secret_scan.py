"""Secret scans over an incremental ledger of blobs, with built-in functions only.

Every text is addressed by the SHA-256 of its content. The ledger holds, for each blob and
rule version, the spans found and the number of the scan that found them; a scan takes one copy of each blob that
the ledger lacks for the current rule version, and findings are joined back to all rows (paths, versions) of the
blob. A large group of equal texts is thus scanned once. A blob that two scans have entered counts once.

A rule is a Java pattern; its matches are leftmost and non-overlapping, and those that fail the
length test are dropped after matching. Positions are code points: the text is cut by the
pattern, and the lengths of the parts and of the matches add up to the starts.

Null texts count as empty. Findings of a row are sorted by start, then by rule order. Very long texts are scanned whole; a text of
n matches takes about n ** 1.5 steps besides the patterns. Repeated rows have the same findings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.shared import named_again, numbered_columns

SPAN = "array<struct<start:bigint,rank:int,kind:string,end:bigint>>"
MASK = "<secret>"


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int  # whose length is tested
    least: int
    base: bool = True
    holds: str = ""  # text that every match has: others are not searched


# fixed values
RULES = (
    Rule("assign", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, holds="AKIA"),
    Rule("hex", r"[0-9a-f]+", 0, 16),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1, False, "PRIVATE KEY-----"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}[.]eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}", 0, 1, False, "eyJ"),
    Rule("git_token", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1, False, "gh"),
)


def rule_version(rules: Sequence[Rule]) -> str:
    return hashlib.sha256(repr(tuple(rules)).encode()).hexdigest()[:16]


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running_sums(x: Column) -> Column:
    """The sum of each value of a bigint array and all before it: folds over pieces of about the root of its size, then over the pieces."""

    def fold(values: Column, of: Callable[[Column], Column]) -> Column:
        return F.aggregate(values, F.array(F.lit(0).cast("long")), lambda done, v: F.concat(done, F.array(F.element_at(done, -1) + of(v))))

    def pieces(step: Column) -> Column:
        starts = F.sequence(F.lit(0), ((F.size(x) - 1) / step).cast("int"))
        inner = F.transform(starts, lambda k: fold(F.slice(x, k * step + 1, step), lambda v: v))

        def moved(each: Column) -> Column:
            return _let(fold(each, lambda c: F.element_at(c, -1)), lambda before: F.flatten(F.transform(each, lambda c, k: F.transform(F.slice(c, F.lit(2), F.size(c)), lambda v: v + F.get(before, k)))))

        return _let(inner, moved)

    return F.when(F.size(x) == 0, F.array().cast("array<bigint>")).otherwise(_let(F.ceil(F.sqrt(F.size(x))).cast("int"), pieces))


def _spans_of(text: Column, rule: Rule, rank: int) -> Column:
    """All spans of one rule; texts without any match of sufficient length skip the work."""
    pattern = rule.pattern
    if rule.group == 0 and pattern.endswith("]+"):
        # runs of one class: asking for the least length cannot move where a match starts or ends
        pattern = pattern[:-1] + "{%d,}" % (rule.least - pattern.find("["))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    tested = F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group))
    parts = F.split(text, pattern, -1)
    match = F.arrays_zip(F.transform(found, lambda m: F.length(m).cast("long")).alias("size"), F.transform(tested, F.length).alias("tested"), F.slice(F.transform(parts, lambda m: F.length(m)), F.lit(1), F.size(found)).alias("before"))

    def placed(m: Column) -> Column:
        ends = running_sums(F.transform(m, lambda x: x["before"] + x["size"]))
        spans = F.zip_with(m, ends, lambda x, end: F.struct((end - x["size"]).alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), end.alias("end"), (x["tested"] >= rule.least).alias("long_enough")))
        return F.transform(F.filter(spans, lambda s: s["long_enough"]), lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"))).cast(SPAN)

    likely = F.contains(text, F.lit(rule.holds)) & text.rlike(pattern) if rule.holds else text.rlike(pattern)
    return F.when(likely, _let(match, placed)).otherwise(F.array().cast(SPAN))


def find_spans(text: Column, rules: Sequence[Rule] = RULES) -> Column:
    """All spans of all rules by start, then rule order."""
    return F.array_sort(F.concat(*[_spans_of(text, r, i) for i, r in enumerate(rules)]))


def scan_unseen(df: DataFrame, ledger: DataFrame | None = None, rules: Sequence[Rule] = RULES, text_col: str = "text") -> DataFrame:
    """New ledger rows (blob, rule_version, scan, spans): one for each blob without one of this rule version.

    Texts travel once, by blob: to the ledger's blobs and to their equals, which the same partitioning serves.
    """
    version = rule_version(rules)
    texts = df.select(blob_id(F.col(text_col)).alias("blob"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.dropDuplicates(["blob"])  # first, as each task then sends one copy of a blob that many rows have
    number = F.lit(1)
    if ledger is not None:
        known = ledger.where(F.col("rule_version") == version)
        number = F.lit((known.agg(F.max("scan")).first()[0] or 0) + 1)
        texts = texts.join(known.select("blob"), "blob", "left_anti")
    return texts.select("blob", F.lit(version).alias("rule_version"), number.cast("int").alias("scan"), find_spans(F.col("text"), rules).alias("spans"))


def join_back(
    df: DataFrame, ledger: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), scans: bool = False
) -> DataFrame:
    """``keep`` columns, blob and spans of every row; rows without findings have an empty list. With ``scans`` also the scan that read the blob."""
    found = ledger.where(F.col("rule_version") == rule_version(rules))
    rows = df.select(*[F.col(k) for k in keep], blob_id(F.col(text_col)).alias("blob"))
    if scans:
        found = found.groupBy("blob").agg(F.min("scan").alias("scan"), F.min_by("spans", "scan").alias("spans"))
    else:
        found = found.where(F.size("spans") > 0).select("blob", "spans").dropDuplicates(["blob"])
    return rows.join(found, "blob", "left").withColumn("spans", F.coalesce("spans", F.array().cast(SPAN)))


def scan(
    df: DataFrame, ledger_path: str | None = None, rules: Sequence[Rule] = RULES, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), scans: bool = False
) -> DataFrame:
    """Scan what the ledger at ``ledger_path`` lacks, append it there, and give the findings of every row.

    Without a path the ledger is a new table in the shared folder.
    """
    from siftwell.llm.shared import shared_dir

    spark = df.sparkSession
    schema = f"blob string, rule_version string, scan int, spans {SPAN}"
    path = ledger_path or shared_dir(spark, "ledger")
    old = None
    if ledger_path is not None:
        try:
            old = spark.read.schema(schema).parquet(path)
        except Exception as e:  # the first scan of this ledger
            if "PATH_NOT_FOUND" not in str(e):
                raise
    scan_unseen(df, old, rules, text_col).write.mode("append").parquet(path)
    return join_back(df, spark.read.schema(schema).parquet(path), rules, text_col, keep, scans)


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with every stretch that spans cover replaced by ``MASK``; spans are sorted by start."""
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        between = F.substring(text, (state["at"] + 1).cast("int"), F.greatest(s["start"] - state["at"], zero).cast("int"))
        out = F.when(s["start"] >= state["at"], F.concat(state["out"], between, F.lit(MASK))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), out.alias("out"))

    whole = F.aggregate(spans, start, step, lambda s: F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def mask_secrets(df: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text", n_chars_col: str | None = "n_chars") -> DataFrame:
    """The rows of ``df`` with secrets masked in the text; ``n_chars_col``, where it is not null, follows the new text."""
    numbered, names = numbered_columns(df)
    text = names[text_col]
    found = join_back(numbered, scan_stored(numbered, rules, text), rules, text, tuple(numbered.columns))
    clean = found.withColumn(text, masked(F.col(text), F.col("spans")))
    if n_chars_col in names:
        n = names[n_chars_col]
        count = F.length(text).cast(df.schema[n_chars_col].dataType)
        clean = clean.withColumn(n, F.when((F.size("spans") > 0) & F.col(n).isNotNull(), count).otherwise(F.col(n)))
    return named_again(clean, names)


def scan_stored(df: DataFrame, rules: Sequence[Rule], text_col: str) -> DataFrame:
    """The ledger of one table, written to the shared folder."""
    from siftwell.llm.shared import stored

    return stored(scan_unseen(df, None, rules, text_col), "ledger")
