"""Cached scores by content hash: lookup, split, upsert, delete, expiry, statistics.

A cache is a Parquet table. Changes make a new version of it: write the result to a new directory and
point readers there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from shoebox.functions.quality import quality_tier


def content_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def alive(analyzed_at: Column, now: Column, days: int | None) -> Column:
    """Not older than the time to live; without one, everything is alive."""
    return F.lit(True) if days is None else analyzed_at >= now - F.make_dt_interval(F.lit(days))


def looked_up(files: DataFrame, cache: DataFrame, now: Column, days: int | None = 365, key: str = "photo_hash") -> DataFrame:
    """Each file with its cached score, and hit; an absent or expired entry is a miss."""
    live = cache.filter(alive(F.col("analyzed_at"), now, days)).withColumn("hit", F.lit(True))
    return files.join(live, key, "left").fillna(False, ["hit"])


def to_analyze(files: DataFrame, cache: DataFrame, now: Column, days: int | None = 365, key: str = "photo_hash") -> DataFrame:
    return files.join(cache.filter(alive(F.col("analyzed_at"), now, days)), key, "left_anti")


def upserted(cache: DataFrame, fresh: DataFrame, key: str = "photo_hash", tie: str = "photo_path") -> DataFrame:
    """The cache with fresh rows in the place of rows of the same key; the latest analysis of a key stays, of equal times
    the last path. Grouped by maximum, so copies of a hot key are merged before they are shuffled."""
    both = cache.unionByName(fresh)
    rest = [c for c in both.columns if c != key]
    best = F.max_by(F.struct(*rest), F.struct("analyzed_at", tie)).alias("r")
    return both.groupBy(key).agg(best).select(key, *(F.col(f"r.{c}").alias(c) for c in rest)).select(*both.columns)


def without(cache: DataFrame, victims: DataFrame, key: str = "photo_hash") -> DataFrame:
    return cache.join(victims.select(key), key, "left_anti")


def without_expired(cache: DataFrame, now: Column, days: int = 365) -> DataFrame:
    return cache.filter(alive(F.col("analyzed_at"), now, days))


def hit_stats(found: DataFrame, by: list[str]) -> DataFrame:
    """Requests, hits, misses and the hit rate in percent; 0 without requests."""
    out = found.groupBy(*by).agg(F.count("*").alias("requests"), F.count_if("hit").alias("hits"))
    return out.withColumn("misses", F.col("requests") - F.col("hits")).withColumn("hit_rate", F.coalesce(F.try_divide(100.0 * F.col("hits"), F.col("requests")), F.lit(0.0)))


def score_by_path(cache: DataFrame, path: str = "photo_path", score: str = "composite_score") -> DataFrame:
    """The latest score of each path; of equal times, the larger hash."""
    return cache.groupBy(path).agg(F.max_by(score, F.struct("analyzed_at", "photo_hash")).alias(score))


def tier_counts(cache: DataFrame, by: list[str] | None = None, score: str = "composite_score") -> DataFrame:
    """(by..., tier, entries) of the tiers that occur."""
    return cache.groupBy(*(by or []), quality_tier(F.col(score)).alias("tier")).agg(F.count("*").alias("entries"))


def results_of(asked: DataFrame, cached: DataFrame, fresh: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """The asked rows with their result, one of cached and fresh (ordinal, results...), whose columns are the same; null where there is
    neither. A row with both has the fresh one. The ordinal gives the order in which they were asked; sorting by it is left to where rows are shown."""
    names = [c for c in cached.columns if c != ordinal]
    both = cached.withColumn("_fresh", F.lit(False)).unionByName(fresh.withColumn("_fresh", F.lit(True)))
    one = both.groupBy(ordinal).agg(F.max_by(F.struct(*names), "_fresh").alias("_r")).select(ordinal, *(F.col(f"_r.{n}").alias(n) for n in names))
    return asked.join(one, ordinal, "left")


def decoded_metadata(text: Column, schema: str) -> Column:
    """A cache row's JSON text as a struct; fields that aren't there, and all of them where the text is no JSON, are null."""
    return F.from_json(text, schema)


def encoded_metadata(fields: Column) -> Column:
    """The JSON text of a struct, with its nulls."""
    return F.to_json(fields, {"ignoreNullFields": "false"})


def versions_compared(cache: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Each row with the values of the row before it under the same key (previous_...)."""
    w = W.Window.partitionBy(key).orderBy(*order)
    return cache.withColumns({f"previous_{c}": F.lag(c).over(w) for c in columns})
