"""The registered queries of the ten operators: name -> (query, SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import katz, langid, quality_classifier, quality_rules, warc
from quern.llm.exact_dedup import exact_dedup
from quern.llm.mixing import mix_to_targets
from quern.llm.near_dedup import near_dedup
from quern.llm.packing import pack_documents
from quern.llm.pii import BASE, find_pii

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


QUERIES["op4_exact_dedup"] = op4_exact_dedup
ORACLES["op4_exact_dedup"] = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""


def op8_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_to_targets(_table(spark, sf_dir, "documents"))


QUERIES["op8_entropy_mixing"] = op8_entropy_mixing


def op5_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES["op5_vector_packing"] = op5_vector_packing


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(_table(spark, sf_dir, "documents"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of(*kinds):
        return F.filter("found", lambda s: s["kind"].isin(*kinds))

    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(of(*BASE)), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"), F.coalesce(F.array_max(F.transform("found", lambda s: s["score"])), F.lit(0.0)).alias("max_score"))


QUERIES["op7_pii"] = op7_pii


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held = langid.remainder("doc_id", 5) == 0
    model = langid.fit(docs.where(~held))
    return langid.identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


QUERIES["op10_langid"] = op10_langid


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = langid.remainder("doc_id", 4) == 2
    docs = _table(spark, sf_dir, "documents")
    model = quality_classifier.fit(docs, _table(spark, sf_dir, "labels").where(~held))
    scored = quality_classifier.score(docs, model)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= quality_classifier.THRESHOLD).cast("int").alias("predicted"))


QUERIES["op3_quality"] = op3_quality


def op9_perplexity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents"))


QUERIES["op9_perplexity_rules"] = op9_perplexity_rules


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(_table(spark, sf_dir, "pages"))
    return back.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def _base32_sql(hexes: str) -> str:
    """SQL for the base32 form of a 40-digit hex string: 20 bits at a time."""
    groups = [f"CAST('0x' || substr({hexes}, {5 * k + 1}, 5) AS BIGINT)" for k in range(8)]
    return " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(({g} >> {s}) & 31 AS INT) + 1, 1)" for g in groups for s in (15, 10, 5, 0))


QUERIES["op1_warc"] = op1_warc
ORACLES["op1_warc"] = f"""
WITH t AS (SELECT page_id, coalesce(html, '') AS p FROM pages), g AS (SELECT page_id, strlen(p) AS payload_bytes, sha1(p) AS h, max(page_id) OVER (PARTITION BY p) AS keeper FROM t)
SELECT page_id, payload_bytes, {_base32_sql('h')} AS payload_digest, CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keeper THEN keeper END AS refers_to FROM g
"""


def op6_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(_table(spark, sf_dir, "documents"), words=4, threshold=80)


QUERIES["op6_circulant_minhash"] = op6_circulant_minhash


def op2_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held = langid.remainder("doc_id", 7) == 2
    model = katz.fit(docs.where(~held))
    return katz.score(model, docs).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")


QUERIES["op2_katz_backoff"] = op2_katz_backoff
