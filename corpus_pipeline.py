"""The training-data pipeline: each stage works on what its predecessor kept.

STAGES are (name, function) pairs; a function takes (spark, docs, sf_dir) and returns a DataFrame, which
is written as Parquet and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoebox.llm import decontaminate, neardup, pieces, pii, toxicity
from shoebox.llm.common import digest_bucket, removed, shared_dir, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxic_documents_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score 0.7 or more. Learns from the labels outside the held-out third. Null and empty texts get the
    model's bias, which is below that unless nothing but toxic rows is labelled; repeated rows and null keys are scored like others."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.score_toxicity(docs, labels, digest_bucket("doc_id", 3) != 1, keep=(*COLUMNS[1:],))
    return scored.filter(F.col("score") < 0.7).select(*COLUMNS)


def one_of_each_group_stays(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near duplicates: five-word shingles,
    similarity 0.8 or more. A repeated doc_id stays once, with the smallest of its texts and of its other columns after that;
    rows without doc_id or words have no group and stay."""
    found = written(neardup.near_duplicates(docs), shared_dir(spark), "groups")
    gone = found.filter("not kept").select("doc_id").distinct()
    left = docs.join(neardup.grows(gone), "doc_id", "left_anti")
    repeated = found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").limit(1).count()
    if repeated:
        first = left.filter("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("first"))
        left = first.select("doc_id", "first.*").unionByName(left.filter("doc_id is null").select(*COLUMNS))
    return left.select(*COLUMNS)


def contaminated_documents_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a twentieth or more of the words lie inside 13-word benchmark windows. Texts without words stay, repeated rows are
    judged alike, and null keys are kept."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.contaminated_words(docs, benchmark, keep=(*COLUMNS[1:],))
    return found.filter(~decontaminate.is_contaminated(F.col("n_hit"), F.col("n_words"))).select(*COLUMNS)


def personal_data_is_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts <EMAIL>, <IP> and so on in the place of personal data; every document stays, and n_chars follows."""
    found = pii.find_personal_data(docs, keep=COLUMNS[1:])
    masked = found.withColumn("text", pii.masked_text("text", "spans"))
    return masked.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def texts_become_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece numbers of each text, after which decoding was tried: (doc_id, lang, source, n_pieces, exact, ids). Null and empty texts
    have none; every row gives a row."""
    found = pieces.encode_pieces(docs, keep=("lang", "source"))
    return found.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_pieces"), "exact", "ids")


STAGES = [
    ("toxicity", toxic_documents_go),
    ("near_duplicates", one_of_each_group_stays),
    ("decontamination", contaminated_documents_go),
    ("personal_data", personal_data_is_masked),
    ("pieces", texts_become_pieces),
]

#: None: a classifier, links over all pairs and Viterbi can't be written in SQL; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_dir(spark)
    for number, (name, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), folder, f"{number}_{name}")
        if number:  # what the last stage read isn't read again
            removed(spark, f"{folder}/{number - 1}_{STAGES[number - 1][0]}")
    return docs
