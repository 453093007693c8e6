"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm import isomedia, jaccard, langid, license_scan, mixing, secret_scan, shared, sharding, spelling, spm, syncmers, urlfilter, warc, whitening

URL_RULES = (
    urlfilter.Rule("allow", "org", "/"),
    urlfilter.Rule("block", "example.org", "/es/"),
    urlfilter.Rule("block", "example.org", "/en/1"),
    urlfilter.Rule("allow", "com", "/fr/"),
    urlfilter.Rule("block", "com", "/de/"),
)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return langid.identify(docs, langid.fit(docs)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = spm.encode(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.xxhash64("begins", "ends").alias("spans_hash"),  # of the byte spans of all ids
    )


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.range_sorted(mixing.mix_plan(_documents(spark, sf_dir)))
    return planned.select("doc_id", "source", "size", "source_size", "weight", "target", "copies", "taken", "first_position", "positions")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    captured = F.timestamp_seconds(F.lit(1_704_067_200) + F.coalesce(F.pmod("page_id", F.lit(100_000_000)), F.lit(0)))
    index = warc.write_archives(_pages(spark, sf_dir).withColumn("captured", captured))
    return warc.read_archives(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT h, max(page_id) AS keep FROM p WHERE strlen(h) >= 1000 GROUP BY h)
SELECT page_id, strlen(p.h) AS payload_bytes, sha1(p.h) AS payload_digest,
  CASE WHEN keep IS NOT NULL AND page_id IS DISTINCT FROM keep THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN keep IS NOT NULL AND page_id IS DISTINCT FROM keep THEN keep END AS refers_to
FROM p LEFT JOIN g ON p.h = g.h
"""


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    pairs = syncmers.with_next(_documents(spark, sf_dir), "doc_id", {"text": text, "anchors": syncmers.placed_anchors(text)})
    edited = F.concat(F.expr("left(text, length(text) - length(text) div 2)"), F.expr("left(next_text, cast(length(text) div 2 as int))"))
    return (
        pairs.withColumn("edited", edited)
        .withColumn("edited_anchors", syncmers.placed_anchors(F.col("edited")))
        .select(
            "doc_id",
            F.length("text").cast("long").alias("n_chars"),
            F.sha2("edited", 256).alias("edited_sha256"),
            syncmers.fingerprint(syncmers.hashes_of(F.col("anchors"))).alias("fingerprint"),
            syncmers.fingerprint(syncmers.hashes_of(F.col("edited_anchors"))).alias("edited_fingerprint"),
            syncmers.likeness(F.col("anchors"), F.col("edited_anchors")).alias("near_edited"),
            syncmers.likeness(F.col("anchors"), F.col("next_anchors")).alias("near_next"),
        )
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.interleaved_shards(_documents(spark, sf_dir), n_shards=16)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source", "fractional_rank"
    )


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(_pages(spark, sf_dir), URL_RULES)


OP8_SQL = r"""
WITH parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages)
SELECT page_id, host, path,
  CASE
    WHEN h_example AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN h_example AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN h_com AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN h_com AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN h_org AND starts_with(path, '/') THEN 'org/'
  END AS rule,
  CASE
    WHEN h_example AND (starts_with(path, '/en/1') OR starts_with(path, '/es/')) THEN 'block'
    WHEN h_com AND starts_with(path, '/de/') THEN 'block'
    ELSE 'allow'
  END AS verdict
FROM (SELECT *, host = 'example.org' OR ends_with(host, '.example.org') AS h_example,
    host = 'com' OR ends_with(host, '.com') AS h_com, host = 'org' OR ends_with(host, '.org') AS h_org FROM parts)
"""


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = isomedia.texts_to_media(_documents(spark, sf_dir))
    probed = isomedia.probe_media(media, keep=("doc_id", "n_bytes"))
    keys = F.transform("keyframes", lambda k: F.concat_ws(":", k["number"], k["start"], k["size"]))
    feature = F.concat_ws(
        ";",
        F.concat(F.lit("codec="), F.trim("codec")),
        F.format_string("timescale=%d;duration=%d;samples=%d", "timescale", "duration", "n_samples"),
        F.concat(F.lit("keyframes="), F.array_join(keys, ",")),
    )
    return probed.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scans through one ledger: what is labelled English first, then the whole table, of which only unseen blobs are read."""
    docs, ledger = _documents(spark, sf_dir), shared.shared_dir(spark, "ledger")
    secret_scan.scan(docs.where("lang = 'en'"), ledger)
    found = secret_scan.scan(docs, ledger, scans=True)
    base = [r.kind for r in secret_scan.RULES if r.base]
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(secret_scan.spans_text(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        secret_scan.spans_text(F.col("spans")).alias("spans"),
        "blob",
        "scan",
    )


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(_documents(spark, sf_dir))


def op12_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(_documents(spark, sf_dir))
    base = F.filter("notices", lambda n: n["base"])
    places = F.transform(base, lambda n: n["word"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    base_labels, labels = F.transform(base, lambda n: n["label"]), F.transform("notices", lambda n: n["label"])
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        joined(base_labels).alias("base_labels"),
        joined(F.concat(labels, F.flatten(F.transform("expressions", lambda e: e["labels"])))).alias("labels"),
        "score",
        F.size("expressions").cast("long").alias("n_expressions"),
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    model = whitening.fit(vectors, k=32)
    rows = whitening.whiten(vectors, model)
    error = whitening.identity_error(rows)
    explained = F.array(*[F.lit(x) for x in model.explained]).cast("array<double>")
    return (
        rows.select("vec_id", "deviation", F.posexplode("whitened").alias("_at", "whitened"))
        .select(
            "vec_id",
            (F.col("_at") + 1).cast("int").alias("component"),
            F.lit(model.n).cast("long").alias("n"),
            "deviation",
            "whitened",
            F.get(explained, F.col("_at")).alias("explained"),
            F.lit(error).cast("double").alias("identity_error"),
        )
    )


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_mixing": op3_mixing,
    "op4_warc": op4_warc,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_fingerprints": op6_fingerprints,
    "op7_sharding": op7_sharding,
    "op8_url_filters": op8_url_filters,
    "op9_media_columns": op9_media_columns,
    "op10_secret_scans": op10_secret_scans,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_license_scans": op12_license_scans,
    "op13_whitening": op13_whitening,
}
ORACLES = {"op4_warc": OP4_SQL, "op8_url_filters": OP8_SQL}
