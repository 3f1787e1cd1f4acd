import random

import pytest
from pyspark.sql import functions as F

from shoebox.config import STRATEGIES, CurationConfig, EmotionalConfig, QualityConfig
from shoebox.operators import curate
from shoebox.operators.ordering import running_totals
from shoebox.plans.curation import curate_years

SCHEMA = "year long, photo_id long, month long, combined double, quality double, emotional double, face_count long"


def photos(spark, rows):
    return spark.createDataFrame([(y, k, m, float(s), float(s), float(s), 0) for y, k, m, s in rows], SCHEMA)


def flagship(spark):
    return photos(spark, [(2024, k, None if k % 11 == 0 else k % 5 + 1, 37 * k % 101) for k in range(30)])


def naive(rows, size=12):
    """Month after month takes its next best, until there are enough; undated photos come last."""
    months = {}
    for _, k, m, s in sorted(rows, key=lambda r: (-r[3], r[1])):
        months.setdefault(m, []).append(k)
    undated, picks = months.pop(None, []), []
    while len(picks) < size and any(months.values()):
        for m in sorted(months):
            if months[m] and len(picks) < size:
                picks.append(months[m].pop(0))
    return picks + undated[: size - len(picks)]


def test_pick_order_and_final_order(spark):
    picks = [r.photo_id for r in curate.by_month(flagship(spark), ["year"]).orderBy("pick").collect()]
    assert picks == [5, 16, 27, 8, 19, 10, 21, 2, 13, 24, 15, 26]
    final = curate.final_order(curate.by_month(flagship(spark), ["year"]), ["year"]).orderBy("place")
    assert [r.photo_id for r in final.collect()] == [5, 10, 15, 16, 21, 26, 27, 2, 8, 13, 19, 24]


def test_round_robin_equals_a_loop(spark):
    rng = random.Random(5)
    rows = [(y, y * 1000 + k, rng.choice([None, *range(1, 13)]) if y % 3 else rng.choice([None, 4]), rng.randint(0, 20)) for y in range(25) for k in range(rng.randint(1, 40))]
    found = {}
    for r in curate.by_month(photos(spark, rows), ["year"]).orderBy("pick").collect():
        found.setdefault(r.year, []).append(r.photo_id)
    for year in {r[0] for r in rows}:
        assert found[year] == naive([r for r in rows if r[0] == year])


def test_few_and_no_photos(spark):
    assert curate.by_month(photos(spark, [(1, 1, 2, 5), (1, 2, None, 9)]), ["year"]).count() == 2
    assert curate_years(photos(spark, []).drop("combined")).count() == 0


def test_top_heavy_and_fallback(spark):
    best = [r.photo_id for r in curate.top_heavy(flagship(spark), ["year"]).orderBy("pick").collect()]
    assert best == sorted(range(30), key=lambda k: (-(37 * k % 101), k))[:12]
    assert {r.strategy for r in curate.with_fallback(photos(spark, [(1, 1, 2, 5)]), ["year"]).collect()} == {"top_heavy"}


def test_fallback_and_ends_shuffle_no_whole_group(spark, tmp_path):
    """Without broadcasts no join by the group's key deals all photos to a few tasks; short and null groups come out like others."""
    rows = [(y, 1000 * (y or 9) + k, k % 12 + 1, k * 7 % 31) for y, n in ((1, 40), (2, 15), (3, 16), (4, 3), (None, 20), (5, 11)) for k in range(n)]
    photos(spark, rows).write.parquet(str(tmp_path / "photos"))
    table = spark.read.parquet(str(tmp_path / "photos"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        picks, ends = curate.with_fallback(table, ["year"]), curate.top_and_bottom(table, ["year"])
        for frame in (picks, ends):
            assert "Join" not in frame._jdf.queryExecution().optimizedPlan().toString()
        picked = {(r.year, r.strategy): [] for r in picks.select("year", "strategy").distinct().collect()}
        for r in picks.orderBy("pick").collect():
            picked[r.year, r.strategy].append(r.photo_id)
        found = {}
        for r in ends.orderBy("place").collect():
            found.setdefault((r.year, r.part), []).append((r.place, r.photo_id))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    groups, best = {}, {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    for year, some in groups.items():
        best[year] = [k for _, k, _, _ in sorted(some, key=lambda r: (-r[3], r[1]))]
    assert picked == {(y, "balanced"): naive(g) for y, g in groups.items() if len(g) >= 12} | {(y, "top_heavy"): best[y] for y, g in groups.items() if len(g) < 12}
    assert found == {(y, "top"): list(enumerate(b[:10], 1)) for y, b in best.items()} | {(y, "bottom"): list(enumerate(b[-5:], 1)) for y, b in best.items() if len(b) > 15}


def test_stats_of_nothing(spark):
    some = photos(spark, [(1, 1, 2, 5)])
    row = curate.selection_stats(some.limit(0), some, ["year"]).first()
    assert (row.total_candidates, row.avg_quality, row.months_represented, row.min_quality) == (1, 0.0, 0, None)


def test_presets_and_checks():
    assert STRATEGIES["aesthetic_first"].quality_weight == 0.7
    for bad in (lambda: CurationConfig(0.5, 0.6), lambda: CurationConfig(similarity=2), lambda: QualityConfig(0.5, 0.3, 0.2), lambda: EmotionalConfig(emotion=10), lambda: EmotionalConfig(high=30)):
        with pytest.raises(ValueError):
            bad()


def test_running_totals_start_from_earlier_buckets(spark):
    rows = spark.range(100).withColumn("b", F.floor(F.col("id") / 7))
    out = running_totals(rows, F.col("b"), ["id"], {"n": F.lit(1), "s": F.col("id")}).orderBy("id").collect()
    assert [r.n for r in out] == list(range(1, 101)) and [r.s for r in out] == [i * (i + 1) // 2 for i in range(100)]


def test_mean_similarity_is_that_of_the_pairs(spark):
    """With constants, copies, opposites, another length, no histogram, groups of one and a null group; whole arrays and channels."""
    import numpy as np

    from shoebox.operators import diversity

    rng, rows = np.random.default_rng(8), []
    for album, count in ((1, 9), (2, 2), (3, 1), (None, 4)):
        rows += [(album, i, i, rng.random(6).tolist()) for i in range(count)]
    rows += [(4, i, i, h) for i, h in enumerate(([1.0, 2, 3, 4, 5, 9], [1.0, 2, 3, 4, 5, 9], [9.0, 5, 4, 3, 2, 1], [2.0] * 6, [3.0] * 6, [7.0, 7, 7, 1, 2, 3], [1.0, 2, 3], None))]
    rows += [(6, 0, 0, []), (6, 1, 1, []), (6, 2, 2, [1.0, 2.0, 3.0, 4.0, 5.0, 9.0])]
    rows = [(a, k, p, h and [float(v) for v in h]) for a, k, p, h in [*rows, (5, 0, 0, None), (5, 1, 1, None)]]
    photos = spark.createDataFrame(rows, "album long, photo_id long, place long, histogram array<double>")
    for channels in ((), (3, 3), (2, 1, 3)):
        some = photos if not channels else photos.filter("histogram is null or size(histogram) in (0, 6)")
        wanted = {r.album: r.m for r in diversity.similarity_pairs(some, channels=channels).groupBy("album").agg(F.avg("similarity").alias("m")).collect()}
        found = {r.album: r.avg_similarity for r in diversity.mean_similarity(some, ["album"], channels=channels).collect()}
        assert found == {album: pytest.approx(m, abs=1e-12) for album, m in wanted.items()} | {3: None}
    assert diversity.mean_similarity(photos.limit(0), ["album"]).count() == 0


def test_a_watched_batch_counts_its_own_rows(spark, tmp_path):
    """The metrics of a real batch are its rows and errors, from the job that made them; the rows are as they were."""
    import pandas as pd

    from shoebox.functions import faces
    from shoebox.operators import reports

    made = tmp_path / "made"
    made.mkdir()

    def detector(frame):
        (made / str(frame["photo_id"].iloc[0])).touch()
        if (frame["photo_id"] % 10 == 3).any():
            raise RuntimeError("broken")
        return pd.Series([[] for _ in range(len(frame))])

    batch = faces.detect_faces(spark.range(0, 40, 1, 4).withColumnRenamed("id", "photo_id"), detector)
    rows, seen = reports.watched(batch, F.col("error").isNotNull())
    assert rows.schema == batch.schema
    rows.write.parquet(str(tmp_path / "out"))
    before = len(list(made.iterdir()))
    found = reports.session_of(seen)
    assert (found["photos_processed"], found["failed"], found["successful"], found["success_rate"]) == (40, 4, 36, 90.0) and len(list(made.iterdir())) == before
    assert found["memory_peak_mb"] > 1 and found["memory_delta_mb"] >= 0 and found["duration"] >= 0
    assert spark.read.parquet(str(tmp_path / "out")).filter("error is not null").count() == 4
    none, seen = reports.watched(batch.limit(0), F.lit(True), "empty")
    none.write.mode("overwrite").parquet(str(tmp_path / "none"))
    assert reports.session_of(seen)["photos_processed"] == 0 and reports.session_of(seen)["memory_peak_mb"] is None
    with pytest.raises(ValueError, match="_at"):
        reports.watched(spark.range(1).withColumn("_at", F.lit(1)), F.lit(False))


def test_results_of_cached_and_fresh(spark):
    from shoebox.operators import cache

    asked = spark.createDataFrame([(i, f"p{i % 3}") for i in range(5)], "ordinal long, path string")
    cached, fresh = (spark.createDataFrame(rows, "ordinal long, score double, note string") for rows in ([(0, 1.0, "c"), (1, 2.0, "c")], [(1, 9.0, None), (3, 4.0, "f"), (8, 5.0, "f")]))
    found = {r.ordinal: (r.path, r.score, r.note) for r in cache.results_of(asked, cached, fresh).collect()}
    assert found == {0: ("p0", 1.0, "c"), 1: ("p1", 9.0, None), 2: ("p2", None, None), 3: ("p0", 4.0, "f"), 4: ("p1", None, None)}
    assert cache.results_of(asked.limit(0), cached, fresh).count() == 0


def test_small_reports(spark):
    """Tiers, months and metadata with nulls, empty tables and texts that are no JSON."""
    from shoebox.functions import dates, faces
    from shoebox.operators import cache, reports

    entries = spark.createDataFrame([(70.0,), (69.9,), (50.0,), (1.0,)], "composite_score double")
    assert {r.tier: r.entries for r in cache.tier_counts(entries).collect()} == {"high": 1, "acceptable": 2, "low": 1}
    texts = spark.createDataFrame([('{"k": 3, "x": "y"}',), ("{}",), ("no",), (None,)], "t string").select(cache.decoded_metadata(F.col("t"), "k long, x string").alias("m"))
    assert [(r.k, r.x) for r in texts.select("m.*").collect()] == [(3, "y"), (None, None), (None, None), (None, None)]
    assert texts.limit(2).select(cache.encoded_metadata(F.col("m")).alias("t")).first().t == '{"k":3,"x":"y"}'
    rows = spark.createDataFrame([("a", "high", 1, "2024-01-05"), ("a", "low", None, None), ("a", None, 1, "2024-01-09"), ("b", "acceptable", 2, "2024-02-01")], "who string, tier string, month long, at string")
    rows = rows.withColumn("taken", F.col("at").cast("timestamp_ntz")).withColumn("photo_id", F.coalesce("at", F.lit("none")))
    assert {r.who: r[1:] for r in reports.tier_report(rows, ["who"]).collect()} == {"a": (3, 1, 0, 1, 1), "b": (1, 0, 1, 0, 1)}
    assert {(r.who, r.month): r.photos for r in curate.photos_by_month(rows, ["who"]).collect()} == {("a", 1): ["2024-01-05", "2024-01-09"], ("b", 2): ["2024-02-01"]}
    shown = rows.select(dates.date_texts(F.col("taken")).alias("d")).select("d.*").collect()
    assert tuple(shown[0]) == ("January", "Jan 05", "2024-01-05") and tuple(shown[1]) == (None, None, None)
    scored = spark.createDataFrame([(80.0, "high", 2), (40.0, "low", 0)], "composite double, tier string, face_count int")
    assert tuple(faces.significance_stats(scored, F.col("tier")).first()) == (2, 60.0, 80.0, 40.0, 1, 0, 1, 1.0, 1)
    assert faces.significance_stats(scored.limit(0), F.col("tier")).first().asDict()["count"] == 0
