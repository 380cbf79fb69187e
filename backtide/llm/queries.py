"""The registered queries of this subpackage: each applies its operator to the whole table and derives the digests."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, hamerly, language, neardup, negatives, pii, pitmanyor, planes, quality, shards, spotsigs, urlrules
from .common import drop_stash, scratch_path, stash


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.shard_by_bytes(_table(spark, sf_dir, "documents"), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_id_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "planes")
    planes.write_planes(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end=1)
    return planes.read_planes(spark, path).select(
        F.col("key").alias("doc_id"), "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


def op3_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spotsigs.fingerprint_with_edits(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        spotsigs.fingerprint(F.col("spots")).alias("fingerprint"),
        spotsigs.fingerprint(F.col("edited_spots")).alias("edited_fingerprint"),
        "near_edited", "near_next",
    )


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page holds the document that its path numbers; that document's labels are the page's."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    labels = stash(_table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality")), "page-labels")
    number = F.regexp_extract(urlrules.url_path(F.col("url")), "/([0-9]+)", 1).try_cast("bigint")
    labelled = pages.withColumn("doc_id", number).join(labels.hint("merge"), "doc_id").select(
        urlrules.url_tokens(F.col("url")).alias("tokens"),
        F.when((F.col("toxic") == 1) | (F.col("quality") == 0), "block").otherwise("allow").alias("label"),
    )
    rules = stash(urlrules.mine_rules(labelled), "rules")
    drop_stash(labels)
    return urlrules.judge_urls(pages, rules)


def op6_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit_quality(docs, _table(spark, sf_dir, "labels"))
    scored = quality.score_quality(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", quality.held_out("doc_id", 5, 0).alias("held_out"), F.col("quality_score").alias("score"), F.col("quality_predicted").alias("predicted"))


def op7_hamming_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_output_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = language.predict_languages(docs.select("doc_id", "text"), language.fit_languages(docs))
    return found.select("doc_id", quality.held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_ambiguous").alias("ambiguous"))


def op9_qgram_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = stash(pii.with_candidates(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "candidates")
    found = pii.find_spans(marked, pii.fit_spans(marked)).select("doc_id", "pii", F.filter("pii", lambda s: s["base"]).alias("base"))

    def number(kind: str, spans: str = "base") -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *map(number, pii.BASE_KINDS),
        F.sha2(pii.span_list(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        pii.span_list(F.col("pii")).alias("spans"),
        F.size("pii").cast("long").alias("n_spans"),
        *[number(kind, "pii") for kind in pii.MORE_KINDS],
    )


def op11_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitmanyor.score_texts(_table(spark, sf_dir, "documents"), quality.held_out("doc_id", 7, 2))


def op12_hamerly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamerly.cluster(_table(spark, sf_dir, "embeddings"))


def op13_score_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(_table(spark, sf_dir, "embeddings").withColumn("label", shifted), F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_byte_shards": op2_byte_shards,
    "op3_spot_signatures": op3_spot_signatures,
    "op4_id_planes": op4_id_planes,
    "op5_url_rules": op5_url_rules,
    "op6_subword_quality": op6_subword_quality,
    "op7_hamming_neardup": op7_hamming_neardup,
    "op8_output_codes": op8_output_codes,
    "op9_qgram_leaks": op9_qgram_leaks,
    "op10_weak_pii": op10_weak_pii,
    "op11_pitman_yor": op11_pitman_yor,
    "op12_hamerly": op12_hamerly,
    "op13_score_sort": op13_score_sort,
}

_COMPONENTS = """
WITH kept AS (
  SELECT vec_id, label, [CAST(floor({factor} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings WHERE {usable} AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
)"""

_ASSIGN = """
, near{n} AS (
  SELECT vec_id, v, arg_min(c, struct_pack(d := d, c := c)) AS c, min(d) AS d
  FROM (SELECT k.vec_id, k.v, m.c, list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(k.v, m.v)])::BIGINT AS d FROM kept k CROSS JOIN centre{n} m)
  GROUP BY vec_id, v
)"""

_MOVE = """
, mean{n} AS (
  SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v
  FROM (SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range(64)) AS i FROM near{n}) GROUP BY c, i) GROUP BY c
), centre{after} AS (SELECT o.c, coalesce(m.v, o.v) AS v FROM centre{n} o LEFT JOIN mean{n} m ON m.c = o.c)"""

_KMEANS = (
    _COMPONENTS.format(factor=64, usable="len(embedding) = 64")
    + """
, centre0 AS (SELECT (row_number() OVER (ORDER BY h) - 1)::INT AS c, v FROM (SELECT sha256('1:' || vec_id) AS h, v FROM kept ORDER BY h LIMIT 16))"""
    + "".join(_ASSIGN.format(n=n) + _MOVE.format(n=n, after=n + 1) for n in range(3))
    + _ASSIGN.format(n=3)
    + """
SELECT a.vec_id, a.c AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia,
  (sum(a.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(m.v, ',')) AS centroid_sha256
FROM near3 a JOIN centre3 m ON m.c = a.c"""
)

_NEGATIVES = (
    _COMPONENTS.format(factor=256, usable="label IS NOT NULL")
    + """
, r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, v FROM kept)
, s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, list_sum([p[1] * p[2] FOR p IN list_zip(a.v, b.v)])::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.positive_id, (row_number() OVER w)::INT AS rank, s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) QUALIFY row_number() OVER w <= 5"""
)

#: The others are held against brute force, round trips or held-out accuracy in tests/llm.
ORACLE_SQL: dict[str, str] = {"op12_hamerly": _KMEANS, "op13_score_sort": _NEGATIVES}
