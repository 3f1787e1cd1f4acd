"""JSON documents: selections, cache exports and library reports, written and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoebox.schemas import EMOTIONAL_CACHE, QUALITY_CACHE, SELECTION


def write_selections(selections: DataFrame, path: str) -> None:
    """One JSON document a line, times as ISO text, null fields kept."""
    selections.write.option("ignoreNullFields", "false").option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss").json(path)


def read_selections(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SELECTION).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss").json(path)


def selected_photos(selections: DataFrame, *keep: str) -> DataFrame:
    """The photos of selections, with their place from 0, and columns of the selection beside them."""
    return selections.select("year", "strategy", *keep, F.posexplode("photos").alias("place", "photo")).select("year", "strategy", *keep, "place", "photo.*")


def paged(photos: DataFrame, by: str, key: str, size: int) -> DataFrame:
    """Adds page: each group is dealt to so many pages that one holds about `size` photos, however large the group."""
    pages = photos.groupBy(by).agg(F.ceil(F.count("*") / size).alias("_pages"))
    return photos.join(pages, by).withColumn("page", F.pmod(F.xxhash64(key), F.col("_pages"))).drop("_pages")


def exported(cache: DataFrame) -> DataFrame:
    """A cache as it is exported: short names and no file size."""
    return cache.select("photo_path", "photo_hash", F.col("sharpness_score").alias("sharpness"), F.col("exposure_score").alias("exposure"), F.col("composite_score").alias("composite"), F.col("quality_tier").alias("tier"), "analyzed_at", "algorithm_version")


def imported(entries: DataFrame) -> DataFrame:
    """Cache rows of exported entries: file size 0, version v1.0 if there is none; entries without hash, path or scores are skipped."""
    need = ["photo_hash", "photo_path", "sharpness", "exposure", "composite", "tier"]
    good = entries.dropna(subset=need)
    values = {"sharpness_score": "sharpness", "exposure_score": "exposure", "composite_score": "composite", "quality_tier": "tier"}
    out = good.select("photo_hash", "photo_path", *(F.col(v).alias(k) for k, v in values.items()), F.lit(0).cast("long").alias("file_size"), F.col("analyzed_at").cast("timestamp_ntz").alias("analyzed_at"), F.coalesce("algorithm_version", F.lit("v1.0")).alias("algorithm_version"))
    return out.to(entries.sparkSession.createDataFrame([], QUALITY_CACHE).schema)


def exported_emotions(cache: DataFrame) -> DataFrame:
    """An emotional cache as it is exported: short names, no file size, metadata as JSON text."""
    short = {"emotion": "emotion_score", "intimacy": "intimacy_score", "engagement": "engagement_score", "composite": "composite_score"}
    return cache.select("photo_path", "photo_hash", "face_count", "face_coverage", *(F.col(v).alias(k) for k, v in short.items()), "tier", "metadata", "analyzed_at", "algorithm_version")


def imported_emotions(entries: DataFrame) -> DataFrame:
    """Emotional cache rows of exported entries: file size 0, version v1.0 and metadata {} if there are none; entries without hash, path,
    face count or scores are skipped, and so are those outside the ranges of the scores."""
    parts = {"emotion_score": ("emotion", 40.0), "intimacy_score": ("intimacy", 100.0), "engagement_score": ("engagement", 100.0), "composite_score": ("composite", 100.0)}
    good = entries.dropna(subset=["photo_hash", "photo_path", "face_count", "face_coverage", "tier", *(n for n, _ in parts.values())]).filter(F.col("face_count") >= 0)
    for name, most in (("face_coverage", 1.0), *parts.values()):
        good = good.filter(F.col(name).between(0.0, most))
    out = good.select(
        "photo_hash", "photo_path", F.col("face_count").cast("int").alias("face_count"), "face_coverage", *(F.col(v).alias(k) for k, (v, _) in parts.items()), "tier", F.coalesce("metadata", F.lit("{}")).alias("metadata"),
        F.lit(0).cast("long").alias("file_size"), F.col("analyzed_at").cast("timestamp_ntz").alias("analyzed_at"), F.coalesce("algorithm_version", F.lit("v1.0")).alias("algorithm_version"),
    )
    return out.to(entries.sparkSession.createDataFrame([], EMOTIONAL_CACHE).schema)


def library_report(photos: DataFrame, by: list[str]) -> DataFrame:
    """Total, photos by tier, and the photo list of each group as one JSON text, best first. The list is as long as the
    group: group by something bounded."""
    photo = F.struct((-F.col("composite")).alias("o"), F.col("name"), F.col("composite"), F.col("sharpness"), F.col("exposure"), F.col("tier"))
    ordered = F.transform(F.array_sort(F.collect_list(photo)), lambda p: p.dropFields("o"))
    return photos.groupBy(*by).agg(F.count("*").alias("total"), *(F.count_if(F.col("tier") == t).alias(t) for t in ("high", "acceptable", "low")), F.to_json(ordered).alias("photos"))
