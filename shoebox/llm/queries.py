"""The registered queries of the training-data operators: thin wrappers that derive the contracts' columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontaminate, divergence, itq, langid, licenses, neardup, neighbours, pieces, pii, secrets, toxicity, warc
from .common import digest_bucket, shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def joined_digest(entries) -> F.Column:
    """Lower-case hex SHA-256 of an array of strings, comma-joined."""
    return F.sha2(F.concat_ws(",", entries).cast("binary"), 256)


def span_strings(spans: str, kinds: list[str] | None = None) -> F.Column:
    """kind:start:end of each span, of these kinds only."""
    kept = F.col(spans) if kinds is None else F.filter(spans, lambda s: s["kind"].isin(kinds))
    return F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))


def count_of(spans: str, kind: str) -> F.Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    base, starts = F.filter("placements", lambda p: p["base"]), lambda c: F.transform(c, lambda p: p["start"])
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts(base)).alias("first_word"), F.array_max(starts(base)).alias("last_word"),
        licenses.label_list(base).alias("base_labels"), licenses.label_list(F.col("placements")).alias("labels"),
        F.coalesce(F.array_max(F.transform("placements", lambda p: p["weight"])), F.lit(0.0)).alias("score"),
    )


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/archives"
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    return warc.read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces.encode_pieces(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.col("n_bytes").alias("n_byte_pieces"), F.col("exact").alias("round_trip"), "ids")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    remainder = digest_bucket("doc_id", 3)
    found = toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), remainder != 1)
    return found.select("doc_id", (remainder == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    base = [r.kind for r in secrets.BASE_RULES]
    return found.select("doc_id", *(count_of("spans", k) for k in base), joined_digest(span_strings("spans", base)).alias("base_sha256"), F.concat_ws(",", span_strings("spans")).alias("spans"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), cfg=neardup.MinHash(shingle=2))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated_words(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), joined_digest(items).alias("items_sha256"), decontaminate.is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    remainder = digest_bucket("doc_id", 5)
    found = langid.identify_languages(table(spark, sf_dir, "documents"), remainder != 0)
    return found.select("doc_id", (remainder == 0).alias("held_out"), "lang_pred", "score")


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    base = list(pii.BASE_KINDS)
    return found.select("doc_id", *(count_of("spans", k) for k in base), joined_digest(span_strings("spans", base)).alias("base_sha256"), F.concat_ws(",", span_strings("spans")).alias("spans"))


def op11_similar_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.similar_embeddings(table(spark, sf_dir, "embeddings"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.token_alignment(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_license_scan, op2_neighbours, op3_warc, op4_pieces, op5_toxicity, op6_secret_scan, op7_near_duplicates, op8_decontamination, op9_language, op10_personal_data, op11_similar_embeddings, op12_token_alignment, op13_source_divergence)}
