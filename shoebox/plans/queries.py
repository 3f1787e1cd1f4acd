"""One registered query for each operator, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from shoebox.config import STRATEGIES, CurationConfig, Settings
from shoebox.functions import dates, faces, pixels, quality
from shoebox.operators import cache, curate, diversity, reports
from shoebox.operators.ordering import top_per_group
from shoebox.schemas import SELECTION
from shoebox.sources import documents, library, media

from . import bindings as b
from .curation import curate_years

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
c = F.col


def query(sql: str | None = None):
    """Registers a query; sql is the same in DuckDB."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def six(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def r6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.combined(b.candidates(spark, sf_dir))


_PICKS = f"""WITH {b.CANDIDATES_SQL},
ranked AS (SELECT *, row_number() OVER (PARTITION BY year, month ORDER BY combined DESC, photo_id) AS rn FROM scored),
placed AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY month IS NULL, rn, month) AS pick FROM ranked),
picks AS (SELECT * FROM placed WHERE pick <= 12)"""


# Selection ---------------------------------------------------------------------------------------


@query(f"{_PICKS} SELECT year, photo_id, month, {r6('combined')}, pick, row_number() OVER (PARTITION BY year ORDER BY coalesce(month, 999), combined DESC, pick) AS place FROM picks")
def curate_balanced(spark, sf_dir):
    out = curate_years(b.candidates(spark, sf_dir))
    return out.select("year", "photo_id", "month", *six("combined"), c("pick").cast("long").alias("pick"), c("place").cast("long").alias("place"))


@query(f"""WITH {b.CANDIDATES_SQL},
s AS (SELECT cand.*, strategy, quality * q + emotional * e AS combined FROM cand, (VALUES ('balanced', CAST(0.4 AS DOUBLE), CAST(0.6 AS DOUBLE)), ('aesthetic_first', 0.7, 0.3), ('people_first', 0.3, 0.7), ('top_heavy', 0.4, 0.6)) t(strategy, q, e)),
m AS (SELECT *, row_number() OVER (PARTITION BY strategy, year, month ORDER BY combined DESC, photo_id) AS rn FROM s),
p AS (SELECT *, CASE WHEN strategy = 'top_heavy' THEN row_number() OVER (PARTITION BY strategy, year ORDER BY combined DESC, photo_id) ELSE row_number() OVER (PARTITION BY strategy, year ORDER BY month IS NULL, rn, month) END AS pick FROM m)
SELECT strategy, year, photo_id, {r6('combined')}, pick FROM p WHERE pick <= 12""")
def curate_all_strategies(spark, sf_dir):
    both = curate.under_strategies(b.candidates(spark, sf_dir), STRATEGIES.values())
    by = ["strategy", "year"]
    out = curate.by_month(both.filter("strategy <> 'top_heavy'"), by).unionByName(curate.top_heavy(both.filter("strategy = 'top_heavy'"), by))
    return out.select(*by, "photo_id", *six("combined"), c("pick").cast("long").alias("pick"))


@query(f"WITH {b.CANDIDATES_SQL} SELECT year, month, photo_id, month_rank FROM (SELECT *, row_number() OVER (PARTITION BY year, month ORDER BY combined DESC, photo_id) AS month_rank FROM scored) WHERE month_rank <= 12")
def month_ranks(spark, sf_dir):
    return curate.month_ranks(scored(spark, sf_dir), ["year"]).select("year", "month", "photo_id", c("month_rank").cast("long").alias("month_rank"))


@query(f"WITH {b.CANDIDATES_SQL} SELECT year, photo_id, {r6('combined')}, place FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY combined DESC, photo_id) AS place FROM scored) WHERE place <= 50")
def preview_top50(spark, sf_dir):
    return top_per_group(scored(spark, sf_dir), ["year"], [F.desc("combined"), c("photo_id")], 50, "place").select("year", "photo_id", *six("combined"), c("place").cast("long").alias("place"))


@query(f"""{_PICKS}, five AS (SELECT * FROM picks WHERE pick <= 5),
both_ AS (SELECT year, photo_id, combined, true AS chosen FROM five UNION ALL SELECT year, photo_id, combined, false FROM scored s WHERE NOT EXISTS (SELECT 1 FROM five f WHERE f.year = s.year AND f.photo_id = s.photo_id))
SELECT year, photo_id, chosen, place FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY chosen DESC, combined DESC, photo_id) AS place FROM both_) WHERE place <= 12""")
def fill_to_twelve(spark, sf_dir):
    photos = scored(spark, sf_dir)
    out = curate.filled(curate.by_month(photos, ["year"], 5), photos, ["year"])
    return out.select("year", "photo_id", "chosen", c("place").cast("long").alias("place"))


@query(f"""{_PICKS}, few AS (SELECT year, avg(quality) AS avg_quality, avg(emotional) AS avg_emotional, avg(combined) AS avg_combined, min(combined) AS min_combined, max(combined) AS max_combined, min(quality) AS min_quality, max(quality) AS max_quality,
    min(emotional) AS min_emotional, max(emotional) AS max_emotional, count(DISTINCT month) AS months_represented, count(*) FILTER (WHERE face_count > 0) AS photos_with_faces, count(*) AS photos FROM picks GROUP BY year),
bins AS (SELECT year, pick, unnest(range(1, len(embedding) + 1)) AS k, CAST(unnest(embedding) AS DOUBLE) AS v FROM picks JOIN embeddings ON vec_id = year % 40 * 12 + pick),
likes AS (SELECT a.year, coalesce(greatest(0, least(1, (corr(a.v, b.v) + 1) / 2)), 1) AS similarity FROM bins a JOIN bins b ON a.year = b.year AND a.pick < b.pick AND a.k = b.k GROUP BY a.year, a.pick, b.pick),
likeness AS (SELECT year, avg(similarity) AS alike FROM likes GROUP BY year)
SELECT year, total_candidates, {r6('avg_quality', 'avg_emotional', 'avg_combined', 'min_combined', 'max_combined', 'min_quality', 'max_quality', 'min_emotional', 'max_emotional')}, months_represented, photos_with_faces, photos, CAST(0 AS BIGINT) AS photos_with_smiles,
    round(coalesce(1 - alike, 0), 6) AS diversity_score
FROM few JOIN (SELECT year, count(*) AS total_candidates FROM scored GROUP BY year) USING (year) LEFT JOIN likeness USING (year)""")
def selection_stats(spark, sf_dir):
    photos = scored(spark, sf_dir)
    out = statistics_of(spark, sf_dir, curate.by_month(photos, ["year"]), photos)
    return out.select("year", "total_candidates", *six("avg_quality", "avg_emotional", "avg_combined", "min_combined", "max_combined", "min_quality", "max_quality", "min_emotional", "max_emotional"), "months_represented", "photos_with_faces", "photos", "photos_with_smiles", *six("diversity_score"))


@query(f"""WITH {b.CANDIDATES_SQL} SELECT year, count(*) AS photos, round(avg(quality), 6) AS avg_quality, round(avg(emotional), 6) AS avg_emotional, round(avg(combined), 6) AS avg_combined, count(*) FILTER (WHERE combined >= 70) AS high,
    count(*) FILTER (WHERE combined >= 50 AND combined < 70) AS medium, count(*) FILTER (WHERE combined < 50) AS low, count(*) FILTER (WHERE face_count > 0) AS with_faces, round(CAST(100 AS DOUBLE) * count(*) FILTER (WHERE combined >= 70) / count(*), 6) AS high_percent FROM scored GROUP BY year""")
def library_stats(spark, sf_dir):
    out = curate.library_stats(scored(spark, sf_dir), ["year"])
    return out.select("year", "photos", *six("avg_quality", "avg_emotional", "avg_combined"), "high", "medium", "low", "with_faces", *six("high_percent"))


@query(f"""WITH {b.CANDIDATES_SQL}, t AS (SELECT year, CASE WHEN quality >= 70 THEN 'high' WHEN quality >= 50 THEN 'acceptable' ELSE 'low' END AS tier, count(*) AS photos FROM cand GROUP BY ALL)
SELECT year, tier, photos, round(CAST(100 AS DOUBLE) * photos / sum(photos) OVER (PARTITION BY year), 6) AS percent FROM t""")
def tier_distribution(spark, sf_dir):
    return curate.tier_distribution(b.candidates(spark, sf_dir), quality.quality_tier(c("quality")), ["year"]).select("year", "tier", "photos", *six("percent"))


@query(f"""WITH {b.CANDIDATES_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY combined DESC, photo_id) AS top, row_number() OVER (PARTITION BY year ORDER BY combined, photo_id DESC) AS back, count(*) OVER (PARTITION BY year) AS n FROM scored)
SELECT year, photo_id, 'top' AS part, top AS place FROM p WHERE top <= 10 UNION ALL SELECT year, photo_id, 'bottom', 6 - back FROM p WHERE back <= 5 AND n > 15""")
def top_and_bottom(spark, sf_dir):
    return curate.top_and_bottom(scored(spark, sf_dir), ["year"]).select("year", "photo_id", "part", c("place").cast("long").alias("place"))


@query(f"""WITH {b.CANDIDATES_SQL}, y AS (SELECT DISTINCT year FROM cand), n AS (SELECT year, month, count(*) AS photos FROM cand WHERE month IS NOT NULL GROUP BY ALL)
SELECT y.year, m AS month, coalesce(photos, 0) AS photos, repeat('█', CAST(least(coalesce(photos, 0), 60) AS INTEGER)) AS bar FROM y CROSS JOIN range(1, 13) r(m) LEFT JOIN n ON n.year = y.year AND n.month = m""")
def month_counts(spark, sf_dir):
    return curate.month_counts(b.candidates(spark, sf_dir), ["year"])


@query(f"WITH {b.CANDIDATES_SQL} SELECT year, count(*) AS photos FROM scored WHERE combined >= 55 GROUP BY year")
def least_combined(spark, sf_dir):
    return curate.combined(b.candidates(spark, sf_dir), CurationConfig(min_combined=55.0)).groupBy("year").agg(F.count("*").alias("photos"))


@query(f"WITH {b.CANDIDATES_SQL} SELECT year, min_by(photo_id, row(-combined, photo_id)) AS best, min_by(photo_id, row(combined, photo_id)) AS worst, round(max(combined), 6) AS best_score, round(min(combined), 6) AS worst_score FROM scored GROUP BY year")
def best_and_worst(spark, sf_dir):
    return curate.best_and_worst(scored(spark, sf_dir), ["year"]).select("year", "best", "worst", *six("best_score", "worst_score"))


@query(f"""WITH {b.CANDIDATES_SQL} SELECT photo_id, round(quality * CAST(0.6 AS DOUBLE) + emotional * CAST(0.4 AS DOUBLE), 6) AS composite, CASE WHEN quality < 30 THEN 'very_blurry' WHEN quality < 50 THEN 'slightly_blurry' WHEN quality < 70 THEN 'adequate' ELSE 'sharp' END AS sharpness_tier,
    CASE WHEN emotional < 30 THEN 'severe' WHEN emotional < 50 THEN 'poor' WHEN emotional < 70 THEN 'acceptable' ELSE 'well_exposed' END AS exposure_tier, round(greatest(0, 50 - quality), 6) AS to_acceptable, round(greatest(0, 70 - quality), 6) AS to_high,
    repeat(CASE WHEN quality >= 70 THEN '🟩' WHEN quality >= 50 THEN '🟨' ELSE '🟥' END, CAST(floor(quality * 30 / 100) AS INTEGER)) || repeat('⬜', 30 - CAST(floor(quality * 30 / 100) AS INTEGER)) AS bar, CAST(CASE face_count WHEN 0 THEN 0 WHEN 1 THEN 20 WHEN 2 THEN 25 ELSE 30 END AS BIGINT) AS points FROM cand""")
def quality_scores(spark, sf_dir):
    q = c("quality")
    return b.candidates(spark, sf_dir).select(
        "photo_id", F.round(quality.quality_score(q, c("emotional")), 6).alias("composite"), quality.sharpness_tier(q).alias("sharpness_tier"), quality.exposure_tier(c("emotional")).alias("exposure_tier"), F.round(quality.points_to(q, 50), 6).alias("to_acceptable"),
        F.round(quality.points_to(q, 70), 6).alias("to_high"), quality.score_bar(q).alias("bar"), quality.face_points(c("face_count")).cast("long").alias("points"),
    )


@query(f"""WITH {b.CANDIDATES_SQL}, v AS (SELECT photo_id, l_partkey, l_suppkey, combined, CASE WHEN combined >= 70 THEN 'high' WHEN combined >= 50 THEN 'acceptable' ELSE 'low' END AS tier FROM scored),
w AS (SELECT *, lag(combined) OVER k AS pc, lag(tier) OVER k AS pt FROM v WINDOW k AS (PARTITION BY l_partkey, l_suppkey ORDER BY photo_id))
SELECT photo_id, round(combined - pc, 6) AS composite_diff, CASE WHEN abs(combined - pc) < CAST(0.1 AS DOUBLE) THEN 'equal' WHEN combined > pc THEN 'score1' ELSE 'score2' END AS better, CASE WHEN tier <> pt THEN tier || ' -> ' || pt END AS change,
    CASE WHEN combined > pc THEN 'first' WHEN pc > combined THEN 'second' ELSE 'tie' END AS emotional_better FROM w WHERE pc IS NOT NULL""")
def versions_compared(spark, sf_dir):
    v = scored(spark, sf_dir).select("photo_id", F.concat_ws("-", "l_partkey", "l_suppkey").alias("of"), "combined", quality.quality_tier(c("combined")).alias("tier"))
    w = cache.versions_compared(v, "of", ["photo_id"], ["combined", "tier"]).filter("previous_combined is not null")
    one, two = c("combined"), c("previous_combined")
    return w.select("photo_id", F.round(one - two, 6).alias("composite_diff"), quality.compared(one, two).alias("better"), quality.tier_change(c("tier"), c("previous_tier")).alias("change"), quality.compared_emotional(one, two).alias("emotional_better"))


@query(f"{_PICKS}, f AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY coalesce(month, 999), combined DESC, pick) AS place FROM picks) SELECT year, photo_id, printf('%02d_score-%d_%s', place, CAST(floor(combined) AS BIGINT), photo_id || '.jpg') AS name FROM f")
def export_names(spark, sf_dir):
    out = curate_years(b.candidates(spark, sf_dir))
    return out.select("year", "photo_id", curate.export_name(c("place"), c("combined"), F.concat("photo_id", F.lit(".jpg"))).alias("name"))


def statistics_of(spark: SparkSession, sf_dir: str, chosen: DataFrame, photos: DataFrame) -> DataFrame:
    """Statistics with the diversity of each year's selection; a picked photo's histogram is a vector of the table."""
    vectors = b.table(spark, sf_dir, "embeddings").select(c("vec_id"), c("embedding").cast("array<double>").alias("histogram"))
    pictures = chosen.withColumn("vec_id", c("year") % 40 * 12 + c("pick")).join(vectors, "vec_id")
    return curate.selection_stats(chosen, photos, ["year"], diversity.mean_similarity(pictures, ["year"]))


@query(f"""{_PICKS}, ordered AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY coalesce(month, 999), combined DESC, pick) - 1 AS place FROM picks), n AS (SELECT year, count(*) AS total_candidates FROM scored GROUP BY year),
a AS (SELECT year, round(avg(combined), 6) AS avg_combined FROM picks GROUP BY year)
SELECT CAST(year AS INTEGER) AS year, 'balanced' AS strategy, '2025-01-01T00:00:00' AS created_at, total_candidates, avg_combined, CAST(place AS INTEGER) AS place, photo_id AS photo_path, ts AS timestamp, CAST(month AS INTEGER) AS month, {r6('combined')},
    CASE WHEN quality >= 70 THEN 'high' WHEN quality >= 50 THEN 'acceptable' ELSE 'low' END AS quality_tier, face_count > 0 AS has_faces FROM ordered JOIN n USING (year) JOIN a USING (year)""")
def selection_documents(spark, sf_dir):
    """The documents, read back: what they hold of each photo and of the whole."""
    photos = scored(spark, sf_dir)
    chosen = curate.final_order(curate.by_month(photos, ["year"]), ["year"]).withColumns({"timestamp": c("ts").cast("timestamp_ntz"), "quality_tier": quality.quality_tier(c("quality")), "emotional_tier": faces.emotional_tier(c("emotional"))})
    written = curate.selection_document(chosen, statistics_of(spark, sf_dir, chosen, photos), "year", F.lit("balanced"), F.lit("2025-01-01T00:00:00"))
    read = written.select(F.from_json("document", SELECTION, {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss"}).alias("d")).select("d.*")
    return documents.selected_photos(read, "created_at", "stats").select(
        "year", "strategy", "created_at", "stats.total_candidates", F.round("stats.avg_combined", 6).alias("avg_combined"), "place", "photo_path", "timestamp", "month", F.round("combined_score", 6).alias("combined"), "metadata.quality_tier", "metadata.has_faces"
    )


@query(f"WITH {b.CANDIDATES_SQL}, t AS (SELECT l_suppkey, month, CASE WHEN quality >= 70 THEN 'high' WHEN quality >= 50 THEN 'acceptable' ELSE 'low' END AS tier FROM cand) SELECT l_suppkey, count(*) AS total, count(*) FILTER (WHERE tier = 'high') AS high, count(*) FILTER (WHERE tier = 'acceptable') AS acceptable, count(*) FILTER (WHERE tier = 'low') AS low, count(DISTINCT month) AS months FROM t GROUP BY l_suppkey")
def library_reports(spark, sf_dir):
    photos = b.candidates(spark, sf_dir).withColumn("tier", quality.quality_tier(c("quality")))
    return reports.tier_report(photos, ["l_suppkey"])


@query(f"""WITH {b.CACHE_SQL}, t AS (SELECT *, CASE WHEN composite_score >= 70 THEN 'high' WHEN composite_score >= 50 THEN 'acceptable' ELSE 'low' END AS tier FROM cached)
SELECT source, photo_path AS name, {r6('composite_score')}, tier, CAST(sum(CASE WHEN tier = 'high' THEN 1 ELSE 0 END) OVER (PARTITION BY source) AS BIGINT) AS high FROM t""")
def library_report_documents(spark, sf_dir):
    """The reports, read back: every photo, and the high ones of its source summed over the source's pages."""
    photos = b.cache_rows(spark, sf_dir).select("source", c("photo_path").alias("name"), c("composite_score").alias("composite"), c("sharpness_score").alias("sharpness"), c("exposure_score").alias("exposure"), quality.quality_tier(c("composite_score")).alias("tier"))
    pages = documents.library_report(documents.paged(photos, "source", "name", 500), ["source", "page"])
    whole = pages.withColumn("high", F.sum("high").over(W.Window.partitionBy("source")))
    read = whole.select("source", "high", F.explode(F.from_json("photos", "array<struct<name string, composite double, tier string>>")).alias("p"))
    return read.select("source", "p.name", F.round("p.composite", 6).alias("composite_score"), "p.tier", "high")


@query(f"{_PICKS}, n AS (SELECT year, count(*) AS k FROM picks GROUP BY year) SELECT year, photo_id, CASE WHEN k < 12 THEN 'top_heavy' ELSE 'balanced' END AS strategy FROM picks JOIN n USING (year)")
def curate_with_fallback(spark, sf_dir):
    return curate.with_fallback(scored(spark, sf_dir).filter("year is not null"), ["year"]).select("year", "photo_id", "strategy")


# Faces -------------------------------------------------------------------------------------------


def significant(spark, sf_dir):
    return faces.score_significance(b.faces(spark, sf_dir))


@query(f"WITH {b.FACES_SQL} SELECT photo_id, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, {r6('distance')} FROM pair")
def face_pairs(spark, sf_dir):
    pairs = b.faces(spark, sf_dir).select("photo_id", F.inline(faces.pair_distances(c("faces"))))
    return pairs.select("photo_id", c("i").cast("long").alias("i"), c("j").cast("long").alias("j"), *six("distance"))


@query(f"WITH {b.FACES_SQL} SELECT photo_id, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, {r6('distance')} FROM (SELECT *, row_number() OVER (PARTITION BY photo_id ORDER BY distance, i, j) AS k FROM pair) WHERE k = 1")
def closest_pairs(spark, sf_dir):
    p = faces.once(b.faces(spark, sf_dir), p=faces.closest_pair(faces.pair_distances(c("faces")))).filter("p is not null")
    return p.select("photo_id", c("p.i").cast("long").alias("i"), c("p.j").cast("long").alias("j"), F.round("p.distance", 6).alias("distance"))


# The texts of reports, as the functions have them.
@query(f"""WITH {b.FACES_SQL} SELECT photo_id, round(coalesce(intimacy, 0), 6) AS intimacy, round(d, 6) AS closest, round(mean, 6) AS average, coalesce(close, 0) AS close_pairs, CASE WHEN n = 1 THEN 'Single person (no proximity to measure)' WHEN d < 1.5 THEN 'Very close/intimate (embracing or very near)'
    WHEN d < 3 THEN 'Close together (friends, couple)' WHEN d < 5 THEN 'Moderate distance (group photo)' ELSE 'Distant (separate individuals)' END AS analysis FROM person LEFT JOIN near USING (photo_id) LEFT JOIN intimate USING (photo_id)""")
def proximity(spark, sf_dir):
    f = b.faces(spark, sf_dir).withColumn("pairs", faces.pair_distances(c("faces")))
    nearest = F.array_min(F.transform("pairs", lambda p: p["distance"]))
    mean = F.when(F.size("pairs") > 0, F.aggregate("pairs", F.lit(0.0), lambda s, p: s + p["distance"]) / F.size("pairs"))
    near = F.size(F.filter("pairs", lambda p: p["distance"] < 3.0)).cast("long")
    return f.select("photo_id", F.round(faces.intimacy(c("pairs")), 6).alias("intimacy"), F.round(nearest, 6).alias("closest"), F.round(mean, 6).alias("average"), near.alias("close_pairs"), faces.proximity_text(c("faces"), nearest).alias("analysis"))


# The texts of reports, as the functions have them.
@query(f"""WITH {b.FACES_SQL} SELECT photo_id, {r6('engagement')}, frontal, partial, profile, round(CAST(frontal AS DOUBLE) / n, 6) AS frontal_ratio, CAST(frontal AS DOUBLE) / n >= 0.6 AS is_group_engaged,
    CASE WHEN CAST(frontal AS DOUBLE) / n >= 0.8 THEN 'High engagement (most faces looking at camera)' WHEN CAST(frontal AS DOUBLE) / n >= 0.5 THEN 'Moderate engagement (about half faces looking at camera)' WHEN CAST(frontal AS DOUBLE) / n >= 0.2 THEN 'Low engagement (few faces looking at camera)' ELSE 'Minimal engagement (mostly profile views)' END AS analysis FROM person""")
def engagement(spark, sf_dir):
    f = b.faces(spark, sf_dir)
    kinds = [_facing(k) for k in ("frontal", "partial", "profile")]
    out = f.select("photo_id", "faces", F.round(faces.engagement(c("faces")), 6).alias("engagement"), *kinds).withColumn("share", c("frontal") / F.size("faces"))
    return out.select("photo_id", "engagement", "frontal", "partial", "profile", F.round("share", 6).alias("frontal_ratio"), (c("share") >= 0.6).alias("is_group_engaged"), faces.engagement_text(c("share"), c("faces")).alias("analysis"))


def _facing(kind):
    return faces.count_of(c("faces"), lambda f: faces.orientation(f) == kind).alias(kind)


@query(f"""WITH {b.FACES_SQL} SELECT photo_id, CAST(n AS BIGINT) AS face_count, round(cover, 10) AS face_coverage, round(presence, 10) AS face_presence, round(emotion, 10) AS emotion, round(intimacy * CAST(0.2 AS DOUBLE), 10) AS intimacy, round(engagement * CAST(0.1 AS DOUBLE), 10) AS engagement, round(composite, 10) AS composite, tier, true AS valid, n > 0 AS has_faces, n >= 2 AS has_group, emotion > 50 AS has_positive_emotion FROM tiered""")
def emotional_scores(spark, sf_dir):
    out = significant(spark, sf_dir)
    names = {"face_presence_component": "face_presence", "emotion_component": "emotion", "intimacy_component": "intimacy", "engagement_component": "engagement"}
    return out.select("photo_id", "face_count", F.round("face_coverage", 10).alias("face_coverage"), *(F.round(k, 10).alias(v) for k, v in names.items()), F.round("composite", 10).alias("composite"), faces.emotional_tier(F.round("composite", 9)).alias("tier"), "valid", (c("face_count") > 0).alias("has_faces"), (c("face_count") >= 2).alias("has_group"), (c("emotion_component") > 50).alias("has_positive_emotion"))


@query(f"""WITH {b.FACES_SQL} SELECT count(*) AS count, round(avg(composite), 6) AS avg_composite, round(max(composite), 6) AS max_composite, round(min(composite), 6) AS min_composite, count(*) FILTER (WHERE tier = 'high') AS high, count(*) FILTER (WHERE tier = 'medium') AS medium, count(*) FILTER (WHERE tier = 'low') AS low, round(avg(n), 6) AS avg_faces, count(*) FILTER (WHERE n > 0) AS with_faces FROM tiered""")
def emotional_stats(spark, sf_dir):
    s = significant(spark, sf_dir).withColumn("tier", faces.emotional_tier(F.round("composite", 9)))
    out = faces.significance_stats(s, c("tier"))
    return out.select("count", *six("avg_composite", "max_composite", "min_composite"), "high", "medium", "low", *six("avg_faces"), "with_faces")


@query(f"WITH {b.FACES_SQL} SELECT photo_id, round(composite, 10) AS composite FROM tiered WHERE tier = 'high'")
def high_significance(spark, sf_dir):
    """The tier filter, best first: the order is the feature. A global sort reads its input twice, first for the borders of its ranges, so the
    high ones are shuffled before it: their scores are computed once."""
    s = significant(spark, sf_dir).filter(faces.emotional_tier(F.round("composite", 9)) == "high")
    return s.select("photo_id", F.round("composite", 10).alias("composite")).repartition("photo_id", "composite").orderBy(F.desc("composite"), "photo_id")


@query(f"WITH {b.FACES_SQL} SELECT photo_id, round(presence, 10) AS presence_part, round(emotion, 10) AS emotion_part, round(intimacy, 10) AS raw_intimacy, round(engagement, 10) AS raw_engagement, CAST(n AS BIGINT) AS faces, round(cover, 10) AS coverage FROM tiered")
def score_breakdowns(spark, sf_dir):
    s = significant(spark, sf_dir).select("photo_id", faces.score_breakdown().alias("s"))
    ten = {"presence_part": "components.face_presence", "emotion_part": "components.emotion", "raw_intimacy": "raw_scores.intimacy", "raw_engagement": "raw_scores.engagement", "coverage": "face_info.coverage"}
    return s.select("photo_id", *(F.round(f"s.{path}", 10).alias(n) for n, path in ten.items()), c("s.face_info.count").alias("faces"))


@query(f"WITH {b.FACES_SQL} SELECT photo_id, count(*) FILTER (WHERE smile >= 0.5) AS smiling, count(*) FILTER (WHERE w * h / CAST(480000 AS DOUBLE) >= 0.005) AS large, max(w * h) AS largest_area, round(max(CAST(w AS DOUBLE) / h), 6) AS widest FROM face GROUP BY photo_id")
def face_properties(spark, sf_dir):
    f = c("faces")
    sized = F.transform(f, lambda x: x.withField("size_ratio", x["w"] * x["h"] / F.lit(480000.0)))
    return b.faces(spark, sf_dir).select("photo_id", faces.smile_count(f).alias("smiling"), F.size(faces.at_least(sized, "size_ratio", 0.005)).cast("long").alias("large"), F.array_max(F.transform(f, lambda x: x["w"] * x["h"])).cast("long").alias("largest_area"), F.round(F.array_max(F.transform(f, faces.aspect)), 6).alias("widest"))


@query("""WITH d AS (SELECT l_orderkey AS photo_id, l_linenumber, l_partkey, l_suppkey, l_shipdate, CAST(l_discount * 10 AS DOUBLE) AS confidence, CAST(trunc((l_partkey % 120 - 10) / CAST(100 AS DOUBLE) * 800) AS BIGINT) AS x0, CAST(trunc((l_suppkey % 110 - 10) / CAST(100 AS DOUBLE) * 600) AS BIGINT) AS y0,
    CAST(trunc((l_partkey % 120 - 10 + l_quantity) / CAST(100 AS DOUBLE) * 800) AS BIGINT) AS x1, CAST(trunc((l_suppkey % 110 - 10 + l_quantity) / CAST(100 AS DOUBLE) * 600) AS BIGINT) AS y1 FROM lineitem WHERE l_orderkey IS NOT NULL),
k AS (SELECT *, least(800, x1) - greatest(0, x0) AS w, least(600, y1) - greatest(0, y0) AS h FROM d WHERE confidence >= 0.5),
f AS (SELECT *, w * h / CAST(480000 AS DOUBLE) AS r FROM k WHERE w > 0 AND h > 0 AND w * h / CAST(480000 AS DOUBLE) BETWEEN 0.05 AND 0.95)
SELECT photo_id, count(*) AS accepted, round(max(r), 10) AS largest FROM f GROUP BY photo_id""")
def raw_detections(spark, sf_dir):
    li, share = b.table(spark, sf_dir, "lineitem").filter("l_orderkey is not null"), lambda e: e / 100.0
    x, y = c("l_partkey") % 120 - 10, c("l_suppkey") % 110 - 10
    box = F.struct(c("l_linenumber").alias("o1"), c("l_partkey").alias("o2"), c("l_suppkey").alias("o3"), c("l_shipdate").alias("o4"), share(x).alias("x"), share(y).alias("y"), share(x + c("l_quantity")).alias("x2"), share(y + c("l_quantity")).alias("y2"), (c("l_discount") * 10).alias("confidence"))
    raw = li.groupBy(c("l_orderkey").alias("photo_id")).agg(F.array_sort(F.collect_list(box)).alias("raw"))
    kept = faces.once(raw, faces=faces.accepted(c("raw"), F.lit(800), F.lit(600))).filter(F.size("faces") > 0)
    return kept.select("photo_id", F.size("faces").cast("long").alias("accepted"), F.round(c("faces")[0]["size_ratio"], 10).alias("largest"))


@query("""WITH s AS (SELECT l_orderkey AS photo_id, count(*) AS n, max(l_quantity * (l_linenumber + 1)) AS area FROM lineitem WHERE l_orderkey IS NOT NULL GROUP BY l_orderkey)
SELECT photo_id, round(least(1, CASE n WHEN 1 THEN CAST(0.6 AS DOUBLE) WHEN 2 THEN 0.8 ELSE 0.9 END + CASE WHEN area / 1000 > 0.2 THEN CAST(0.1 AS DOUBLE) WHEN area / 1000 > 0.1 THEN 0.05 ELSE 0 END), 6) AS confidence FROM s""")
def smile_confidence(spark, sf_dir):
    li = b.table(spark, sf_dir, "lineitem").filter("l_orderkey is not null")
    smiles = li.groupBy(c("l_orderkey").alias("photo_id")).agg(F.collect_list(F.struct(c("l_quantity").alias("w"), (c("l_linenumber") + 1).alias("h"))).alias("smiles"))
    return smiles.select("photo_id", F.round(faces.smile_confidence(c("smiles"), F.lit(40), F.lit(25)), 6).alias("confidence"))


# Caches and files --------------------------------------------------------------------------------

def today():
    return F.lit("2024-06-30").cast("timestamp_ntz")


@query("SELECT doc_id, sha256(coalesce(text, '')) AS photo_hash, octet_length(encode(coalesce(text, ''))) AS file_size FROM documents")
def content_hashes(spark, sf_dir):
    return b.cache_rows(spark, sf_dir).select("doc_id", "photo_hash", "file_size")


_LATEST = "latest AS (SELECT photo_hash, max_by(composite_score, row(analyzed_at, photo_path)) AS composite_score, max(analyzed_at) AS analyzed_at FROM cached GROUP BY photo_hash)"


def latest(spark, sf_dir):
    rows = b.cache_rows(spark, sf_dir)
    return cache.upserted(rows.filter("doc_id % 2 = 0"), rows.filter("doc_id % 2 = 1"))


@query(f"WITH {b.CACHE_SQL}, {_LATEST} SELECT photo_hash, {r6('composite_score')}, analyzed_at FROM latest")
def cache_upserted(spark, sf_dir):
    """Rows of odd ids are upserted into the cache of the even ones; the latest analysis of a hash stays."""
    return latest(spark, sf_dir).select("photo_hash", *six("composite_score"), "analyzed_at")


@query(f"WITH {b.CACHE_SQL}, {_LATEST} SELECT source, count(*) AS requests, count(l.photo_hash) AS hits, count(*) - count(l.photo_hash) AS misses, round(CAST(100 AS DOUBLE) * count(l.photo_hash) / count(*), 6) AS hit_rate FROM cached f LEFT JOIN latest l ON f.photo_hash = l.photo_hash AND l.analyzed_at >= TIMESTAMP '2024-06-30' - to_days(365) GROUP BY source")
def cache_hits(spark, sf_dir):
    files = b.cache_rows(spark, sf_dir).select("photo_hash", "source", "doc_id")
    found = cache.looked_up(files, latest(spark, sf_dir).select("photo_hash", "composite_score", "analyzed_at"), today())
    return cache.hit_stats(found, ["source"]).select("source", "requests", "hits", "misses", *six("hit_rate"))


@query(f"WITH {b.CACHE_SQL}, {_LATEST} SELECT doc_id FROM cached f WHERE NOT EXISTS (SELECT 1 FROM latest l WHERE f.photo_hash = l.photo_hash AND l.analyzed_at >= TIMESTAMP '2024-06-30' - to_days(365))")
def cache_to_analyze(spark, sf_dir):
    return cache.to_analyze(b.cache_rows(spark, sf_dir).select("photo_hash", "doc_id"), latest(spark, sf_dir), today()).select("doc_id")


@query(f"WITH {b.CACHE_SQL}, {_LATEST} SELECT photo_hash FROM latest WHERE photo_hash NOT IN (SELECT photo_hash FROM cached WHERE composite_score < 30)")
def cache_deleted(spark, sf_dir):
    victims = b.cache_rows(spark, sf_dir).filter("composite_score < 30")
    return cache.without(latest(spark, sf_dir), victims).select("photo_hash")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-31' - to_days(14)")
def cache_unexpired(spark, sf_dir):
    log = b.table(spark, sf_dir, "events").withColumn("analyzed_at", c("ts"))
    return cache.without_expired(log, F.lit("2024-01-31").cast("timestamp_ntz"), 14).select("event_id")


@query(f"WITH {b.CACHE_SQL} SELECT CASE WHEN composite_score >= 70 THEN 'high' WHEN composite_score >= 50 THEN 'acceptable' ELSE 'low' END AS tier, count(*) AS entries FROM cached GROUP BY tier")
def cache_tiers(spark, sf_dir):
    return cache.tier_counts(b.cache_rows(spark, sf_dir))


@query(f"WITH {b.CACHE_SQL} SELECT photo_path, round(max_by(composite_score, row(analyzed_at, photo_hash)), 6) AS composite_score FROM cached GROUP BY photo_path")
def cache_scores(spark, sf_dir):
    return cache.score_by_path(b.cache_rows(spark, sf_dir)).select("photo_path", *six("composite_score"))


@query(f"WITH {b.CACHE_SQL} SELECT doc_id AS ordinal, photo_path, round(CASE WHEN doc_id % 3 <> 0 THEN composite_score END, 6) AS composite_score FROM cached")
def results_in_order(spark, sf_dir):
    """The asked paths with their result, or null where the analysis failed, with the order in which they were asked; cached and
    fresh results are united."""
    rows = b.cache_rows(spark, sf_dir).withColumnRenamed("doc_id", "ordinal")
    some = rows.select("ordinal", "composite_score")
    out = cache.results_of(rows.select("ordinal", "photo_path"), some.filter("ordinal % 3 = 1"), some.filter("ordinal % 3 = 2"))
    return out.select("ordinal", "photo_path", *six("composite_score"))


@query(f"WITH {b.CACHE_SQL} SELECT photo_hash, photo_path, round(composite_score, 6) AS composite_score, CAST(0 AS BIGINT) AS file_size, analyzed_at, CASE WHEN doc_id % 2 = 0 THEN 'v1.1' ELSE 'v1.0' END AS algorithm_version FROM cached WHERE doc_id % 10 <> 0")
def cache_round_trip(spark, sf_dir):
    """Exported to JSON text and imported again: sizes become 0, missing versions v1.0, broken entries are skipped."""
    rows = b.cache_rows(spark, sf_dir).withColumn("algorithm_version", F.when(c("doc_id") % 2 == 0, "v1.1")).withColumn("quality_tier", quality.quality_tier(c("composite_score")))
    broken = F.when(c("doc_id") % 10 != 0, c("photo_hash"))
    text = documents.exported(rows.withColumn("photo_hash", broken)).select(F.to_json(F.struct("*")).alias("line"))
    back = text.select(F.from_json("line", "photo_path string, photo_hash string, sharpness double, exposure double, composite double, tier string, analyzed_at timestamp_ntz, algorithm_version string").alias("e")).select("e.*")
    return documents.imported(back).select("photo_hash", "photo_path", *six("composite_score"), "file_size", "analyzed_at", "algorithm_version")


@query(f"WITH {b.PAGES_SQL} SELECT page_id, path, reason AS skip_reason FROM reasoned WHERE folder NOT IN ('.hidden', '__MACOSX')")
def scan_reasons(spark, sf_dir):
    return library.scanned(b.page_files(spark, sf_dir)).select("page_id", "path", "skip_reason")


@query(f"""WITH {b.PAGES_SQL}, n AS (SELECT folder, reason, count(*) AS k FROM reasoned WHERE folder NOT IN ('.hidden', '__MACOSX') GROUP BY ALL)
SELECT folder, CAST(sum(CASE WHEN reason IS NULL THEN k ELSE 0 END) AS BIGINT) AS found, CAST(sum(CASE WHEN reason IS NOT NULL THEN k ELSE 0 END) AS BIGINT) AS skipped, string_agg(reason || '=' || k, ',' ORDER BY reason) AS reasons FROM n GROUP BY folder""")
def scan_counts(spark, sf_dir):
    """By root, with all roots reported."""
    out = library.scan_statistics(library.scanned(b.page_files(spark, sf_dir)), ["folder"])
    text = F.concat_ws(",", F.transform(F.map_entries("reasons"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))))
    return out.select("folder", "found", "skipped", text.alias("reasons"))


@query(f"WITH {b.PAGES_SQL} SELECT path FROM reasoned WHERE reason IS NULL AND folder NOT IN ('.hidden', '__MACOSX') ORDER BY path, page_id LIMIT 100")
def scan_first_hundred(spark, sf_dir):
    return library.photos(b.page_files(spark, sf_dir), 100).select("path")


# The texts of reports, as the functions have them.
@query(f"""WITH {b.PAGES_SQL}, asked AS (SELECT page_id, url AS path FROM pages UNION ALL SELECT -1 - page_id, 'none:' || page_id FROM pages WHERE page_id % 4 = 0),
file AS (SELECT url AS path, max(ext) AS ext, max(length) AS length, bool_or(is_dir) AS is_dir FROM typed GROUP BY url)
SELECT page_id, CASE WHEN file.path IS NULL THEN 'not_found' WHEN is_dir THEN 'not_a_file' WHEN length < 1024 THEN 'too_small' END AS reason,
    CASE WHEN file.path IS NULL THEN 'File not found' WHEN is_dir THEN 'Not a file' WHEN length = 0 THEN 'Empty file' END AS message FROM asked LEFT JOIN file USING (path)""")
def paths_validated(spark, sf_dir):
    pages = b.table(spark, sf_dir, "pages")
    asked = pages.select("page_id", c("url").alias("path")).unionByName(pages.filter("page_id % 4 = 0").select((-1 - c("page_id")).alias("page_id"), F.concat(F.lit("none:"), c("page_id").cast("string")).alias("path")))
    files = b.page_files(spark, sf_dir).groupBy(c("url").alias("path")).agg(F.max("length").alias("length"), F.bool_or("is_dir").alias("is_dir"))
    asked, files = asked.withColumn("path", F.concat("path", F.lit("#.jpg"))), files.withColumn("path", F.concat("path", F.lit("#.jpg")))
    one, two = library.validated(asked, files).select("page_id", "reason"), library.split_messages(asked, files).select("page_id", "message")
    return one.join(two, "page_id")


@query(f"""WITH {b.CACHE_SQL}, f AS (SELECT source, CASE WHEN doc_id % 4 <> 0 THEN doc_id % 9 END AS sub, CASE WHEN doc_id % 4 <> 0 AND doc_id % 5 <> 0 THEN doc_id % 7 END AS inner_, doc_id % 11 = 0 AS deeper FROM cached),
g2 AS (SELECT source, sub, inner_, count(*) FILTER (WHERE NOT deeper) AS n FROM f WHERE inner_ IS NOT NULL GROUP BY ALL),
s2 AS (SELECT *, row_number() OVER (PARTITION BY source, sub ORDER BY inner_) AS k, count(*) OVER (PARTITION BY source, sub) AS folders FROM g2),
m2 AS (SELECT source, sub, avg(n) AS mean, max(folders) AS folders FROM s2 WHERE k <= 5 GROUP BY ALL),
h1 AS (SELECT source, sub, count(*) FILTER (WHERE inner_ IS NULL) AS here FROM f WHERE sub IS NOT NULL GROUP BY ALL),
g1 AS (SELECT source, sub, CAST(floor(here + coalesce(mean * folders, 0)) AS BIGINT) AS n FROM h1 LEFT JOIN m2 USING (source, sub)),
s1 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sub) AS k, count(*) OVER (PARTITION BY source) AS folders FROM g1)
SELECT h.source, CAST(floor(here + coalesce(mean * folders, 0)) AS BIGINT) AS estimate FROM (SELECT source, count(*) FILTER (WHERE sub IS NULL) AS here FROM f GROUP BY source) h LEFT JOIN (SELECT source, avg(n) AS mean, max(folders) AS folders FROM s1 WHERE k <= 5 GROUP BY source) m USING (source)""")
def scan_estimate(spark, sf_dir):
    """A document lies in a folder, in one of its nine subfolders, in one of the seven below that, or deeper still."""
    i = c("doc_id")
    inner = F.when((i % 4 != 0) & (i % 5 != 0), i % 7)
    rows = b.cache_rows(spark, sf_dir).withColumns({"sub": F.when(i % 4 != 0, i % 9), "inner": inner, "deeper": F.when(inner.isNotNull() & (i % 11 == 0), 1)})
    return library.estimated_count(rows, ["source", "sub", "inner", "deeper"])


@query("""WITH RECURSIVE n AS (SELECT page_id, 'p' || (page_id % 29) || CASE WHEN page_id % 4 = 0 THEN '_' || (page_id % 3 + 1) ELSE '' END AS stem, ['.jpg', '', '.tar.gz'][page_id % 3 + 1] AS tail, page_id % 29 AS family FROM pages),
m AS (SELECT page_id, family, regexp_extract(stem || tail, '^(.+?)(\\.[^.]*)?$', 1) AS head, regexp_extract(stem || tail, '^.+?(\\.[^.]*)?$', 1) AS suffix, row_number() OVER (PARTITION BY family ORDER BY page_id) AS k, count(*) OVER (PARTITION BY family) AS many FROM n),
r AS (SELECT family, page_id, k, head || suffix AS stored_name, [head || suffix] AS taken FROM m WHERE k = 1
    UNION ALL SELECT family, page_id, k, free AS stored_name, list_append(taken, free) AS taken FROM (SELECT m.family, m.page_id, m.k, r.taken,
        list_filter(list_concat([head || suffix], list_transform(range(1, many + 1), lambda i: head || '_' || i || suffix)), lambda x: NOT list_contains(r.taken, x))[1] AS free FROM r JOIN m ON m.family = r.family AND m.k = r.k + 1))
SELECT page_id, stored_name FROM r""")
def collision_free_names(spark, sf_dir):
    """Names that get into each other's way in every manner; the SQL tries name after name, row after row."""
    i = c("page_id")
    name = F.concat(F.lit("p"), (i % 29).cast("string"), F.when(i % 4 == 0, F.concat(F.lit("_"), (i % 3 + 1).cast("string"))).otherwise(""), F.element_at(F.array(F.lit(".jpg"), F.lit(""), F.lit(".tar.gz")), (i % 3 + 1).cast("int")))
    return library.collision_free(b.table(spark, sf_dir, "pages").select("page_id", name.alias("name")), "name", "page_id").select("page_id", "stored_name")


@query(f"WITH {b.PAGES_SQL} SELECT page_id, CASE ext WHEN '.jpg' THEN 'image/jpeg' WHEN '.jpeg' THEN 'image/jpeg' WHEN '.png' THEN 'image/png' WHEN '.heic' THEN 'image/heic' WHEN '.heif' THEN 'image/heif' ELSE 'application/octet-stream' END AS content_type, url || '=d' AS download FROM typed")
def content_types(spark, sf_dir):
    return b.page_files(spark, sf_dir).select("page_id", library.content_type(c("path")).alias("content_type"), media.download_url(c("url")).alias("download"))


# Batches -----------------------------------------------------------------------------------------


@query("SELECT user_id, count(*) AS total, count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) FILTER (WHERE event_type <> 'error') AS successful, round(CAST(100 AS DOUBLE) * count(*) FILTER (WHERE event_type <> 'error') / count(*), 6) AS success_rate FROM events GROUP BY user_id")
def batch_results(spark, sf_dir):
    return reports.batch_result(b.work_log(spark, sf_dir), c("failed"), ["user_id"]).select("user_id", "total", "failed", "successful", *six("success_rate"))


@query("""WITH n AS (SELECT *, (row_number() OVER (ORDER BY ts, event_id) - 1) // 500 AS chunk FROM events)
SELECT chunk, count(*) AS total, count(*) FILTER (WHERE event_type = 'error') AS failed FROM n GROUP BY chunk""")
def batch_chunks(spark, sf_dir):
    return reports.chunked(b.work_log(spark, sf_dir), c("failed"), F.date_trunc("hour", "ts"), ["ts", "event_id"], 500).select("chunk", "total", "failed")


@query("SELECT event_id, row_number() OVER w AS done, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS failures FROM events WINDOW w AS (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def batch_progress(spark, sf_dir):
    return reports.progress(b.work_log(spark, sf_dir), c("failed"), F.date_trunc("hour", "ts"), ["ts", "event_id"]).select("event_id", "done", "failures")


_SESSIONS = """s AS (SELECT user_id, date_trunc('day', ts) AS day, (epoch_us(max(ts)) - epoch_us(min(ts))) / CAST(1000000 AS DOUBLE) AS duration, count(*) AS photos_processed, max(value) AS memory_peak_mb, max_by(value, row(ts, event_id)) - min_by(value, row(ts, event_id)) AS memory_delta_mb FROM events GROUP BY ALL)"""


@query(f"WITH {_SESSIONS} SELECT user_id, day, {r6('duration')}, photos_processed, {r6('memory_peak_mb', 'memory_delta_mb')} FROM s")
def session_metrics(spark, sf_dir):
    log = b.work_log(spark, sf_dir).withColumn("day", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    return reports.session_metrics(log, ["user_id", "day"]).select("user_id", "day", *six("duration"), "photos_processed", *six("memory_peak_mb", "memory_delta_mb"))


@query(f"WITH {_SESSIONS} SELECT user_id, count(*) AS num_sessions, round(sum(duration), 6) AS total_duration, CAST(sum(photos_processed) AS BIGINT) AS total_photos, round(CASE WHEN sum(duration) > 0 THEN sum(photos_processed) / sum(duration) ELSE 0 END, 6) AS avg_photos_per_second, round(max(memory_peak_mb), 6) AS peak_memory_mb FROM s GROUP BY user_id")
def session_summaries(spark, sf_dir):
    log = b.work_log(spark, sf_dir).withColumn("day", F.date_trunc("day", "ts"))
    out = reports.session_summary(reports.session_metrics(log, ["user_id", "day"]), ["user_id"])
    return out.select("user_id", "num_sessions", *six("total_duration"), "total_photos", *six("avg_photos_per_second", "peak_memory_mb"))


@query("""WITH h AS (SELECT user_id, count(*) FILTER (WHERE v >= 250) / CAST(count(*) AS DOUBLE) AS clipped, count(*) FILTER (WHERE v < 5) / CAST(count(*) AS DOUBLE) AS crushed, count(*) FILTER (WHERE v >= 50 AND v < 200) / CAST(count(*) AS DOUBLE) AS middle, avg(v) AS mean, stddev_pop(v) AS deviation
    FROM (SELECT user_id, CAST(floor(value) AS BIGINT) % 256 AS v FROM events WHERE value IS NOT NULL) GROUP BY user_id)
SELECT user_id, round(greatest(0, least(100, 100 - clipped * 100 - crushed * 100 + middle * 50)), 6) AS exposure, round(mean, 6) AS mean, round(deviation, 5) AS deviation,
    concat_ws(',', CASE WHEN clipped > CAST(0.05 AS DOUBLE) THEN 'overexposed' END, CASE WHEN crushed > CAST(0.05 AS DOUBLE) THEN 'underexposed' END, CASE WHEN deviation < 30 THEN 'low_contrast' END) AS issues FROM h""")
def exposure_issues(spark, sf_dir):
    v = b.table(spark, sf_dir, "events").filter("value is not null").select("user_id", (F.floor("value") % 256).alias("v"))
    n, share = F.count("*"), lambda t: F.count_if(t) / F.count("*")
    h = v.groupBy("user_id").agg(n.alias("n"), share(c("v") >= 250).alias("clipped"), share(c("v") < 5).alias("crushed"), share((c("v") >= 50) & (c("v") < 200)).alias("middle"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("deviation"))
    return h.select("user_id", F.round(quality.exposure_score(c("clipped"), c("crushed"), c("middle")), 6).alias("exposure"), *six("mean"), F.round("deviation", 5).alias("deviation"), F.concat_ws(",", quality.exposure_issues(c("clipped"), c("crushed"), c("deviation"))).alias("issues"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def metadata_decoded(spark, sf_dir):
    return b.table(spark, sf_dir, "events").select("event_id", cache.decoded_metadata(c("props"), "k long")["k"].alias("k"))


@query("""SELECT event_id, ts AS timestamp, month(ts) AS month, CASE event_id % 4 WHEN 0 THEN 'jpg' WHEN 1 THEN 'png' WHEN 2 THEN 'heic' ELSE 'jpg' END AS format, CAST(CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 4000 END AS BIGINT) AS width FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)""")
def media_items(spark, sf_dir):
    e, i = b.table(spark, sf_dir, "events"), c("event_id")
    mime = F.element_at(F.array(*map(F.lit, ("image/jpeg", "image/png", "image/heic", "image/webp"))), (i % 4 + 1).cast("int"))
    items = e.select("event_id", F.lit("http://host/x").alias("baseUrl"), mime.alias("mimeType"), F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("creationTime"), F.when(i % 3 != 0, (i % 4000).cast("string")).alias("width"), F.lit("x").alias("height")).alias("mediaMetadata"))
    out = media.item_metadata(items)
    return out.select("event_id", c("timestamp").cast("timestamp_ntz").alias("timestamp"), c("month").cast("long").alias("month"), "format", c("width").cast("long").alias("width"))


# Dates -------------------------------------------------------------------------------------------


def with_dates(spark, sf_dir):
    d = b.dated(spark, sf_dir)
    return d.withColumn("exif", dates.exif_datetime(dates.first_present(c("f36867"), c("f306"), c("f36868")))).withColumn("info", dates.datetime_info(c("exif"), c("mtime"))).withColumn("ts", c("info.datetime"))


@query(f"WITH {b.DATES_SQL} SELECT photo_id, ts AS datetime, month(ts) AS month, year(ts) AS year, CASE WHEN exif IS NOT NULL THEN 'exif' ELSE 'file_mtime' END AS source, exif FROM stamped")
def datetime_infos(spark, sf_dir):
    return with_dates(spark, sf_dir).select("photo_id", "info.datetime", "info.month", "info.year", "info.source", "exif")


@query(f"WITH {b.DATES_SQL} SELECT y AS year, count(*) FILTER (WHERE year(ts) = y) AS strict, count(*) FILTER (WHERE ts IS NULL OR year(ts) = y) AS tolerant FROM stamped, (SELECT DISTINCT year(o_orderdate) AS y FROM orders) GROUP BY y")
def year_predicates(spark, sf_dir):
    """Photos of each year, strictly, and with the undated ones that every year's scoring lets pass: the one count of
    undated photos is added to each year's, in a window over the few counts by year."""
    counts = with_dates(spark, sf_dir).groupBy(F.year("ts").cast("long").alias("year")).agg(F.count("*").alias("n"))
    years = b.table(spark, sf_dir, "orders").select(F.year("o_orderdate").cast("long").alias("year")).distinct()
    both = counts.withColumn("asked", F.lit(False)).unionByName(years.select("year", F.lit(0).cast("long").alias("n"), F.lit(True).alias("asked")))
    sums = both.groupBy("year").agg(F.sum("n").alias("strict"), F.bool_or("asked").alias("asked"))
    undated = F.coalesce(F.max(F.when(c("year").isNull(), c("strict"))).over(W.Window.partitionBy()), F.lit(0))
    return sums.withColumn("tolerant", c("strict") + undated).filter("asked").select("year", "strict", "tolerant")


@query(f"WITH {b.DATES_SQL} SELECT photo_id // 1000 AS album, month(ts) AS month, string_agg(CAST(photo_id AS VARCHAR), ',' ORDER BY photo_id) AS photos FROM stamped WHERE ts IS NOT NULL GROUP BY ALL")
def photos_by_month(spark, sf_dir):
    albums = with_dates(spark, sf_dir).withColumn("album", F.floor(c("photo_id") / 1000))
    return curate.photos_by_month(albums, ["album"], "ts").withColumn("photos", F.concat_ws(",", F.transform("photos", lambda x: x.cast("string"))))


@query(f"WITH {b.DATES_SQL} SELECT photo_id, strftime(ts, '%B') AS month_name, strftime(ts, '%b %d') AS day, strftime(ts, '%Y-%m-%d') AS date FROM stamped")
def date_texts(spark, sf_dir):
    return with_dates(spark, sf_dir).select("photo_id", dates.date_texts(c("ts")).alias("d")).select("photo_id", "d.*")


# Similarity --------------------------------------------------------------------------------------


@query(f"WITH {b.ALBUMS_SQL} SELECT album, first, second, {r6('similarity')}, similarity < 0.85 AS diverse FROM sims")
def similarity_pairs(spark, sf_dir):
    return diversity.similarity_pairs(b.albums(spark, sf_dir)).select("album", "first", "second", *six("similarity"), diversity.is_diverse(c("similarity")).alias("diverse"))


@query(f"WITH {b.ALBUMS_SQL}, m AS (SELECT album, first, second, similarity FROM sims UNION ALL SELECT album, second, first, similarity FROM sims UNION ALL SELECT album, photo_id, photo_id, 1 FROM photo) SELECT album, first, second, {r6('similarity')} FROM m")
def similarity_matrices(spark, sf_dir):
    photos = b.albums(spark, sf_dir)
    return diversity.similarity_matrix(diversity.similarity_pairs(photos), photos).select("album", "first", "second", *six("similarity"))


@query(f"""WITH {b.ALBUMS_SQL}, s AS (SELECT album, avg(similarity) AS a, min(similarity) AS lo, max(similarity) AS hi, count(*) FILTER (WHERE similarity > 0.85) AS k FROM sims GROUP BY album)
SELECT p.album, round(coalesce(a, 0), 6) AS avg_similarity, round(coalesce(lo, 0), 6) AS min_similarity, round(coalesce(hi, 0), 6) AS max_similarity, round(1 - coalesce(a, 0), 6) AS diversity, coalesce(k, 0) AS similar_pairs FROM (SELECT DISTINCT album FROM photo) p LEFT JOIN s USING (album)""")
def diversity_stats(spark, sf_dir):
    photos = b.albums(spark, sf_dir)
    out = diversity.diversity_stats(diversity.similarity_pairs(photos), photos)
    return out.select("album", *six("avg_similarity", "min_similarity", "max_similarity", "diversity"), "similar_pairs")


@query(f"""WITH RECURSIVE {b.ALBUMS_SQL}, near AS (SELECT second AS photo_id, list(first) AS l FROM sims WHERE similarity >= 0.6 GROUP BY second),
q AS (SELECT album, photo_id, row_number() OVER (PARTITION BY album ORDER BY place) AS k, coalesce(l, []) AS l FROM photo LEFT JOIN near USING (photo_id)),
r AS (SELECT album, k, [photo_id] AS kept FROM q WHERE k = 1 UNION ALL SELECT q.album, q.k, CASE WHEN list_has_any(kept, q.l) THEN kept ELSE list_append(kept, q.photo_id) END FROM r JOIN q ON q.album = r.album AND q.k = r.k + 1),
z AS (SELECT album, arg_max(kept, k) AS kept FROM r GROUP BY album)
SELECT album, CAST(unnest(range(len(kept))) AS INTEGER) AS position, unnest(kept) AS photo FROM z""")
def without_similar(spark, sf_dir):
    return diversity.without_similar(b.albums(spark, sf_dir), threshold=0.6)


@query(f"""WITH RECURSIVE {b.ALBUMS_SQL}, sides AS (SELECT first AS x, second AS y, similarity AS v FROM sims UNION ALL SELECT second, first, similarity FROM sims),
r AS (SELECT album, 1 AS n, [arg_min(photo_id, place)] AS kept FROM photo GROUP BY album UNION ALL SELECT album, n + 1, list_append(kept, x) FROM
    (SELECT r.album, n, kept, x, place, min(v) AS v FROM r JOIN photo USING (album) JOIN sides ON x = photo_id AND list_contains(kept, y) AND NOT list_contains(kept, x) WHERE n < 5 GROUP BY ALL)
    QUALIFY row_number() OVER (PARTITION BY album ORDER BY v, place) = 1),
z AS (SELECT album, CASE WHEN (SELECT count(*) FROM photo WHERE photo.album = t.album) <= 5 THEN (SELECT list(photo_id ORDER BY place) FROM photo WHERE photo.album = t.album) ELSE t.kept END AS kept
    FROM (SELECT album, arg_max(kept, n) AS kept FROM r GROUP BY album) t)
SELECT album, CAST(unnest(range(len(kept))) AS INTEGER) AS position, unnest(kept) AS photo FROM z""")
def most_diverse(spark, sf_dir):
    return diversity.most_diverse(b.albums(spark, sf_dir), 5)


# Pixels ------------------------------------------------------------------------------------------


@query()
def pixel_scores(spark, sf_dir):
    out = pixels.pixel_scores(b.page_images(spark, sf_dir), "page_id", Settings().quality.max_side)
    return out.select("page_id", *six("sharpness", "exposure", "mean", "deviation"), "error")


@query("""WITH p AS (SELECT page_id, greatest(1, (octet_length(encode(coalesce(html, ''))) + 63) // 64) AS h FROM pages) SELECT page_id, CAST(CASE WHEN greatest(h, 64) > 1024 THEN floor(h * CAST(1024 AS DOUBLE) / greatest(h, 64)) ELSE h END AS BIGINT) AS height, CAST(CASE WHEN greatest(h, 64) > 1024 THEN floor(CAST(65536 AS DOUBLE) / greatest(h, 64)) ELSE 64 END AS BIGINT) AS width FROM p""")
def target_sizes(spark, sf_dir):
    size = pixels.target_size(c("height"), c("width"))
    return b.page_images(spark, sf_dir).select("page_id", size["height"].cast("long").alias("height"), size["width"].cast("long").alias("width"))
