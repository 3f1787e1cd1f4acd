"""The best photos of a year: combined score, month round-robin, statistics."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from shoebox.config import CurationConfig

from .ordering import top_per_group


def combined(photos: DataFrame, config: CurationConfig = CurationConfig()) -> DataFrame:
    """Adds the combined score, and drops photos under the least."""
    score = F.col("quality") * config.quality_weight + F.col("emotional") * config.emotional_weight
    return photos.withColumn("combined", score).filter(F.col("combined") >= config.min_combined)


def under_strategies(photos: DataFrame, configs: Iterable[CurationConfig]) -> DataFrame:
    """Each photo once for each configuration, with its combined score under that one. The configurations are an array
    in the plan, so nothing is joined."""
    options = F.array(*(F.struct(F.lit(c.strategy).alias("strategy"), F.lit(c.quality_weight).alias("q"), F.lit(c.emotional_weight).alias("e"), F.lit(c.min_combined).alias("least")) for c in configs))
    spread = photos.withColumn("_c", F.explode(options)).withColumn("strategy", F.col("_c.strategy"))
    spread = spread.withColumn("combined", F.col("quality") * F.col("_c.q") + F.col("emotional") * F.col("_c.e"))
    return spread.filter(F.col("combined") >= F.col("_c.least")).drop("_c")


def month_ranks(photos: DataFrame, by: list[str], size: int = 12, key: str = "photo_id") -> DataFrame:
    """The best `size` of each month with their place in it (month_rank). No selection takes more of a month."""
    return top_per_group(photos, [*by, "month"], [F.desc("combined"), F.col(key)], size, "month_rank")


def by_month(photos: DataFrame, by: list[str], size: int = 12, key: str = "photo_id") -> DataFrame:
    """The best of each month, then the second of each month in month order, and so on; undated photos only when
    the dated ones are used up. The round-robin is an order: (undated, month_rank, month), cut at `size`."""
    order = [F.col("month").isNull(), F.col("month_rank"), F.col("month")]
    return top_per_group(month_ranks(photos, by, size, key), by, order, size, "pick").drop("month_rank")


def top_heavy(photos: DataFrame, by: list[str], size: int = 12, key: str = "photo_id") -> DataFrame:
    return top_per_group(photos, by, [F.desc("combined"), F.col(key)], size, "pick")


def selected(photos: DataFrame, by: list[str], config: CurationConfig = CurationConfig(), key: str = "photo_id") -> DataFrame:
    return (top_heavy if config.strategy == "top_heavy" else by_month)(photos, by, config.size, key)


def filled(chosen: DataFrame, photos: DataFrame, by: list[str], size: int = 12, key: str = "photo_id") -> DataFrame:
    """chosen and, up to `size` in each group, the best of the photos that aren't chosen."""
    rest = photos.join(chosen.select(*by, key), [*by, key], "left_anti").withColumn("chosen", F.lit(False))
    both = chosen.withColumn("chosen", F.lit(True)).unionByName(rest, allowMissingColumns=True)
    return top_per_group(both, by, [F.desc("chosen"), F.desc("combined"), F.col(key)], size, "place")


def final_order(chosen: DataFrame, by: list[str], key: str = "photo_id") -> DataFrame:
    """Adds the place in the printed selection: by month, undated last, best first."""
    order = W.Window.partitionBy(*by).orderBy(F.coalesce("month", F.lit(999)), F.desc("combined"), "pick")
    return chosen.withColumn("place", F.row_number().over(order))


def selection_stats(chosen: DataFrame, candidates: DataFrame, by: list[str], alike: DataFrame | None = None) -> DataFrame:
    """One row for each group of candidates. Photos with smiles are always 0: no photo carries that mark. An empty
    selection has zeros and no minima or maxima. alike: the mean similarity of each selection (by..., avg_similarity),
    as mean_similarity() gives it; diversity_score is 1 less that, 0 where there is none."""
    scores = ("quality", "emotional", "combined")
    few = chosen.groupBy(*by).agg(
        *(F.avg(s).alias(f"avg_{s}") for s in scores), *(f(s).alias(f"{n}_{s}") for s in scores for n, f in (("min", F.min), ("max", F.max))),
        F.count_distinct("month").alias("months_represented"), F.count_if(F.col("face_count") > 0).alias("photos_with_faces"), F.count("*").alias("photos"),
    )
    out = candidates.groupBy(*by).agg(F.count("*").alias("total_candidates")).join(few, by, "left")
    zeros = {n: 0.0 for n in ("avg_quality", "avg_emotional", "avg_combined")} | {n: 0 for n in ("months_represented", "photos_with_faces", "photos")}
    out = out.fillna(zeros).withColumn("photos_with_smiles", F.lit(0).cast("long"))
    if alike is None:
        return out.withColumn("diversity_score", F.lit(0.0))
    return out.join(alike.select(*by, (1 - F.col("avg_similarity")).alias("diversity_score")), by, "left").fillna(0.0, ["diversity_score"])


def with_fallback(photos: DataFrame, by: list[str], config: CurationConfig = CurationConfig(), key: str = "photo_id") -> DataFrame:
    """A group with fewer than `size` picks is selected again top-heavy, and labelled so. Every strategy takes `size` photos if there are
    that many, so the picks of such a group are all its photos: they are ranked again, and nothing is read twice."""
    group = W.Window.partitionBy(*by)
    first = selected(photos, by, config, key).withColumn("_short", F.count("*").over(group) < config.size)
    again = F.row_number().over(group.orderBy(F.desc("combined"), key))
    out = first.withColumn("pick", F.when(F.col("_short"), again).otherwise(F.col("pick")))
    return out.withColumn("strategy", F.when(F.col("_short"), "top_heavy").otherwise(config.strategy)).drop("_short")


def tier_distribution(photos: DataFrame, tier: Column, by: list[str]) -> DataFrame:
    """Photos and their percentage by tier."""
    counts = photos.groupBy(*by, tier.alias("tier")).agg(F.count("*").alias("photos"))
    return counts.withColumn("percent", 100.0 * F.col("photos") / F.sum("photos").over(W.Window.partitionBy(*by)))


def library_stats(photos: DataFrame, by: list[str]) -> DataFrame:
    """Averages, three bands with percentages, and photos with faces; percentages of nothing are null."""
    total, c = F.count("*"), F.col("combined")
    bands = {"high": F.count_if(c >= 70), "medium": F.count_if((c >= 50) & (c < 70)), "low": F.count_if(c < 50), "with_faces": F.count_if(F.col("face_count") > 0)}
    averages = [F.avg(s).alias(f"avg_{s}") for s in ("quality", "emotional", "combined")]
    return photos.groupBy(*by).agg(total.alias("photos"), *averages, *(x.alias(n) for n, x in bands.items()), *(F.try_divide(100.0 * x, total).alias(f"{n}_percent") for n, x in bands.items()))


def month_counts(photos: DataFrame, by: list[str]) -> DataFrame:
    """All twelve months of each group, with 0 where there is no photo, and a bar."""
    counts = photos.groupBy(*by).agg(*(F.count_if(F.col("month") == m).alias(f"m{m}") for m in range(1, 13)))
    months = F.array(*(F.struct(F.lit(m).cast("long").alias("month"), F.col(f"m{m}").alias("photos")) for m in range(1, 13)))
    return counts.select(*by, F.inline(months)).withColumn("bar", F.repeat(F.lit("█"), F.least(F.col("photos"), F.lit(60)).cast("int")))


def photos_by_month(photos: DataFrame, by: list[str], when: str = "taken", key: str = "photo_id") -> DataFrame:
    """(by..., month, photos array): the photos of each month, in the order of their keys; undated ones are in none. A group is an album, whose size the
    caller bounds: its lists are rows."""
    dated = photos.filter(F.col(when).isNotNull())
    return dated.groupBy(*by, F.month(when).cast("long").alias("month")).agg(F.array_sort(F.collect_list(key)).alias("photos"))


def best_and_worst(photos: DataFrame, by: list[str], key: str = "photo_id") -> DataFrame:
    order = lambda sign: F.struct(sign * F.col("combined"), F.col(key))
    return photos.groupBy(*by).agg(F.min_by(key, order(-1)).alias("best"), F.min_by(key, order(1)).alias("worst"), F.max("combined").alias("best_score"), F.min("combined").alias("worst_score"))


def top_and_bottom(photos: DataFrame, by: list[str], top: int = 10, bottom: int = 5, guard: int = 15, key: str = "photo_id") -> DataFrame:
    """The best rows, and the last ones in the same (descending) order if a group has over `guard` rows. Whether it has is seen from its
    first guard + 1 rows, so only rows that are cut to a few of each group are shuffled."""
    best = top_per_group(photos, by, [F.desc("combined"), F.col(key)], max(top, guard + 1), "place").withColumn("part", F.lit("top"))
    last = top_per_group(photos, by, [F.asc("combined"), F.desc(key)], bottom, "place").withColumn("part", F.lit("bottom"))
    group, is_top = W.Window.partitionBy(*by), F.col("part") == "top"
    both = best.unionByName(last).withColumns({"_seen": F.count_if(is_top).over(group), "_last": F.count_if(~is_top).over(group)})
    kept = both.filter((is_top & (F.col("place") <= top)) | (~is_top & (F.col("_seen") > guard)))
    return kept.withColumn("place", F.when(is_top, F.col("place")).otherwise(F.col("_last") + 1 - F.col("place")).cast("int")).drop("_seen", "_last")


def export_name(place: Column, score: Column, name: Column) -> Column:
    return F.format_string("%02d_score-%d_%s", place, F.floor(score).cast("int"), name)


def selection_document(chosen: DataFrame, stats: DataFrame, year: str, strategy: Column, created_at: Column) -> DataFrame:
    """(year, document): one JSON text a year with the layout of schemas.SELECTION; photos (at most a selection's size) in final
    order. chosen has photo_id, timestamp, month, the three scores, face_count and tiers; stats is selection_stats()."""
    marks = F.struct("quality_tier", "emotional_tier", (F.col("face_count") > 0).alias("has_faces"), F.col("face_count").cast("int").alias("face_count"), (F.col("emotional_tier") == "high").alias("has_positive_emotion"))
    photo = F.struct(F.col("photo_id").alias("photo_path"), "timestamp", F.col("month").cast("int").alias("month"), *(F.col(s).alias(f"{s}_score") for s in ("quality", "emotional", "combined")), marks.alias("metadata"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("place", photo.alias("photo")))), lambda p: p["photo"])
    known = [c for c in stats.columns if c not in (year, "photos")]
    numbers = stats.select(year, F.struct(*known).alias("stats"))
    whole = F.struct(F.col(year).cast("int").alias("year"), strategy.alias("strategy"), created_at.alias("created_at"), "stats", "photos")
    options = {"ignoreNullFields": "false", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss"}
    return chosen.groupBy(year).agg(ordered.alias("photos")).join(numbers, year).select(year, F.to_json(whole, options).alias("document"))
