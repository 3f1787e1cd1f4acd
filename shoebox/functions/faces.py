"""Human significance from detected faces: expressions over an array of face structs (x, y, w, h, smile).

Everything stays in the photo's row, so no face is shuffled; the detector that fills the array is pluggable.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoebox.config import EmotionalConfig
from shoebox.schemas import FACES

from .quality import banded, clamped

DEFAULT = EmotionalConfig()


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often use mentions it and wherever Catalyst moves the result."""
    return F.element_at(F.transform(F.array(value), use), 1)


def bisected(call: Callable[[pd.DataFrame], list], frame: pd.DataFrame) -> tuple[list, list[str | None]]:
    """What call gives for each row of the frame, and the error of each row it fails for. A frame that fails (or for which there are more or fewer
    results than rows) is halved until the rows at fault are alone: a bad row of n costs about 2 log n calls."""
    try:
        found = list(call(frame))
        if len(found) != len(frame):
            raise ValueError(f"{len(found)} results for {len(frame)} photos")
        return found, [None] * len(frame)
    except Exception as e:  # noqa: BLE001  one photo must not end the scan
        if len(frame) == 1:
            return [None], [f"{type(e).__name__}: {e}"]
    half = len(frame) // 2
    first, second = bisected(call, frame.iloc[:half]), bisected(call, frame.iloc[half:])
    return first[0] + second[0], first[1] + second[1]


def detect_faces(photos: DataFrame, detector: Callable[[pd.DataFrame], pd.Series], key: str = "photo_id", batch: int = 64) -> DataFrame:
    """Rows (key, faces, error): detector gets at most `batch` photos and returns a list of face dicts for each. A
    batch that fails is halved until the photos at fault are alone; these have a null array and the error's text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                found, errors = bisected(detector, part)
                yield pd.DataFrame({key: part[key].to_numpy(), "faces": found, "error": errors})

    return photos.mapInPandas(run, f"{key} {photos.schema[key].dataType.simpleString()}, faces {FACES}, error string")


def accepted(raw: Column, width: Column, height: Column, config: EmotionalConfig = DEFAULT) -> Column:
    """Raw boxes (x, y, x2, y2 as shares of the image, confidence) to faces: sure enough, cut to the image, not
    empty, of a plausible size; the first max_faces of them, largest first."""
    whole = lambda share, side: (share * side).cast("int")
    sure = F.filter(raw, lambda d: d["confidence"] >= config.confidence)
    cut = F.transform(sure, lambda d: F.struct(F.greatest(F.lit(0), whole(d["x"], width)).alias("x"), F.greatest(F.lit(0), whole(d["y"], height)).alias("y"), F.least(width, whole(d["x2"], width)).alias("x2"), F.least(height, whole(d["y2"], height)).alias("y2"), d["confidence"].alias("confidence")))
    sized = F.transform(cut, lambda d: F.struct(d["x"].alias("x"), d["y"].alias("y"), (d["x2"] - d["x"]).alias("w"), (d["y2"] - d["y"]).alias("h"), d["confidence"].alias("confidence"), ((d["x2"] - d["x"]) * (d["y2"] - d["y"]) / (width * height)).cast("double").alias("size_ratio")))
    good = F.filter(sized, lambda f: (f["w"] > 0) & (f["h"] > 0) & f["size_ratio"].between(config.min_size, config.max_size))
    ordered = F.transform(F.slice(good, 1, config.max_faces), lambda f, i: F.struct((-f["size_ratio"]).alias("k"), i.alias("i"), f.alias("f")))
    return F.transform(F.array_sort(ordered), lambda o: o["f"])


def at_least(faces: Column, name: str, least: float) -> Column:
    return F.filter(faces, lambda f: f[name] >= least)


def total(faces: Column, of) -> Column:
    return F.aggregate(faces, F.lit(0.0), lambda s, f: s + of(f).cast("double"))


def count_of(faces: Column, test) -> Column:
    return F.size(F.filter(faces, lambda f: F.coalesce(test(f), F.lit(False)))).cast("long")


def mean_of(faces: Column, of) -> Column:
    return F.when(F.size(faces) > 0, total(faces, of) / F.size(faces))


def coverage(faces: Column, width: Column, height: Column) -> Column:
    return F.least(F.lit(1.0), total(faces, lambda f: f["w"] * f["h"]) / (width * height))


def aspect(face: Column) -> Column:
    return F.when(face["h"] > 0, face["w"] / face["h"]).otherwise(F.lit(0.0))


def is_smiling(face: Column) -> Column:
    return face["smile"] > 0.5


def smile_count(faces: Column, least: float = 0.5) -> Column:
    """Here the limit itself counts, other than in is_smiling."""
    return count_of(faces, lambda f: f["smile"] >= least)


def pair_distances(faces: Column) -> Column:
    """array<struct<i, j, distance>> of all pairs i < j (from 1) in units of the mean face width; empty if that is 0."""
    none = F.array().cast("array<struct<i:int,j:int,distance:double>>")
    return over_pairs(faces, lambda i, j, distance: F.struct(i.alias("i"), j.alias("j"), distance.alias("distance")), none)


def over_pairs(faces: Column, of: Callable[[Column, Column, Column], Column], none: Column) -> Column:
    """The array of of(i, j, distance) over all pairs as in pair_distances; `none` if the mean width is 0. Each face's middle is computed once."""
    middle = lambda f, at, side: f[at] + F.floor(f[side] / 2)

    def distance(f: Column, g: Column) -> Column:
        across, down = f["x"] - g["x"], f["y"] - g["y"]
        return F.sqrt((across * across + down * down).cast("double"))

    def pairs(middles: Column, width: Column) -> Column:
        with_later = lambda f, i: F.transform(F.slice(middles, i + 2, F.size(middles)), lambda g, k: of(i + 1, i + k + 2, distance(f, g) / width))
        return F.when(width > 0, F.flatten(F.transform(middles, with_later))).otherwise(none)

    middles = F.transform(faces, lambda f: F.struct(middle(f, "x", "w").alias("x"), middle(f, "y", "h").alias("y")))
    return bound(mean_of(faces, lambda f: f["w"]), lambda width: bound(middles, lambda m: pairs(m, width)))


def once(rows: DataFrame, **values: Column) -> DataFrame:
    """Adds the values in a Generate, which Catalyst neither merges with what uses them nor lets filters through: each
    is computed once for a row, where a filter on a column of a projection computes what it mentions again at every mention."""
    return rows.select("*", F.inline(F.array(F.struct(*(v.alias(n) for n, v in values.items())))))


def closest_pair(pairs: Column) -> Column:
    """The struct (i, j, distance) with the smallest distance, the first of equals."""
    first = F.array_min(F.transform(pairs, lambda p: F.struct(p["distance"].alias("distance"), p["i"].alias("i"), p["j"].alias("j"))))
    return first


def closeness(distance: Column, config: EmotionalConfig = DEFAULT) -> Column:
    """Points for the smallest distance: 90 when very close, falling in straight lines to 75, 55 and 25."""
    # The points at the limits.
    far = 2 * config.moderate
    line = lambda low, high, top, bottom: F.lit(top) - (F.least(distance, F.lit(high)) - low) * ((top - bottom) / (high - low))
    return F.when(distance < config.very_close, 90.0).when(distance < config.close, line(config.very_close, config.close, 90.0, 75.0)).when(distance < config.moderate, line(config.close, config.moderate, 75.0, 55.0)).otherwise(line(config.moderate, far, 55.0, 25.0))


def intimacy(pairs: Column, config: EmotionalConfig = DEFAULT) -> Column:
    """Closeness of the nearest pair, ten points more (100 at most) when two pairs or more are close; 0 without pairs."""
    return intimacy_of(F.transform(pairs, lambda p: p["distance"]), config)


def intimacy_of(distances: Column, config: EmotionalConfig = DEFAULT) -> Column:
    """intimacy() from the distances alone."""

    def points(p: Column) -> Column:
        near = F.size(F.filter(p, lambda d: d < config.close))
        score = bound(F.array_min(p), lambda d: closeness(d, config))
        return F.when(F.size(p) == 0, 0.0).otherwise(F.least(F.lit(100.0), score + F.when(near >= 2, 10.0).otherwise(0.0)))

    return bound(distances, points)


def proximity_text(faces: Column, nearest: Column, config: EmotionalConfig = DEFAULT) -> Column:
    # The texts of reports.
    return (F.when(F.size(faces) == 0, "No faces detected").when(F.size(faces) == 1, "Single person (no proximity to measure)")
            .when(nearest < config.very_close, "Very close/intimate (embracing or very near)").when(nearest < config.close, "Close together (friends, couple)")
            .when(nearest < config.moderate, "Moderate distance (group photo)").otherwise("Distant (separate individuals)"))


def orientation(face: Column) -> Column:
    ratio = aspect(face)
    return F.when(ratio.between(0.75, 1.25), "frontal").when((ratio < 0.6) | (ratio > 1 / 0.6), "profile").otherwise("partial")


def engagement_points(face: Column) -> Column:
    look = orientation(face)
    return F.when(look == "frontal", 100.0).when(look == "profile", 20.0).otherwise(60.0)


def engagement(faces: Column) -> Column:
    return F.coalesce(mean_of(faces, engagement_points), F.lit(0.0))


def engagement_text(share: Column, faces: Column) -> Column:
    # The texts of reports.
    return (F.when(F.size(faces) == 0, "No faces detected").when(share >= 0.8, "High engagement (most faces looking at camera)")
            .when(share >= 0.5, "Moderate engagement (about half faces looking at camera)").when(share >= 0.2, "Low engagement (few faces looking at camera)")
            .otherwise("Minimal engagement (mostly profile views)"))


def face_presence(count: Column, cover: Column, config: EmotionalConfig = DEFAULT) -> Column:
    points = F.when(count == 0, 0.0).when(count == 1, 10 + 10 * cover).when(count == 2, 20 + 5 * cover).when(count < 5, 25 + 3 * cover).otherwise(28 + F.least(F.lit(2.0), 0.5 * (count - 5)))
    return F.least(F.lit(config.face_presence), points)


def emotion(faces: Column, config: EmotionalConfig = DEFAULT) -> Column:
    smiling = F.filter(faces, lambda f: F.coalesce(is_smiling(f), F.lit(False)))
    points = lambda s: F.when(F.size(faces) == 0, 0.0).when(F.size(s) == 0, 5.0).otherwise(30.0 * F.size(s) / F.size(faces) + 10 * mean_of(s, lambda f: f["smile"]))
    return F.least(F.lit(config.emotion), bound(smiling, points))


def emotional_tier(score: Column, config: EmotionalConfig = DEFAULT) -> Column:
    return banded(score, ("low", "medium", "high"), (config.medium, config.high))


def smile_confidence(smiles: Column, width: Column, height: Column) -> Column:
    """From the smile boxes (w, h) found in a face: by their number, more if the largest is large for the face."""
    largest = F.array_max(F.transform(smiles, lambda s: s["w"] * s["h"]))
    share = F.when(width * height > 0, largest / (width * height)).otherwise(0.0)
    basis = F.when(F.size(smiles) == 1, 0.6).when(F.size(smiles) == 2, 0.8).otherwise(0.9)
    return F.when(F.size(smiles) == 0, 0.0).otherwise(F.least(F.lit(1.0), basis + F.when(share > 0.2, 0.1).when(share > 0.1, 0.05).otherwise(0.0)))


def score_significance(photos: DataFrame, config: EmotionalConfig = DEFAULT, faces: str = "faces", width: str = "width", height: str = "height") -> DataFrame:
    """Adds face_count, face_coverage, the raw intimacy and engagement, the four components, composite, tier and valid. What goes through the faces
    is computed once; the rest is arithmetic on it."""
    f, one = F.col(faces), F.col
    distances = over_pairs(f, lambda i, j, distance: distance, F.array().cast("array<double>"))
    out = once(
        photos.withColumn("pairs", pair_distances(f)), face_count=F.size(f).cast("long"), face_coverage=coverage(f, one(width), one(height)),
        intimacy_score=intimacy_of(distances, config), engagement_score=engagement(f), emotion_component=emotion(f, config),
    )
    out = out.withColumns({
        "face_presence_component": face_presence(one("face_count"), one("face_coverage"), config),
        "intimacy_component": one("intimacy_score") * (config.intimacy / 100), "engagement_component": one("engagement_score") * (config.engagement / 100),
    })
    parts = {"face_presence_component": config.face_presence, "emotion_component": config.emotion, "intimacy_component": config.intimacy, "engagement_component": config.engagement}
    valid = F.lit(True)
    for name, most in parts.items():
        valid = valid & one(name).between(0, most)
    score = one("face_presence_component") + one("emotion_component") + one("intimacy_component") + one("engagement_component")
    return out.withColumn("composite", clamped(score)).withColumns({"tier": emotional_tier(one("composite"), config), "valid": valid})


def score_breakdown() -> Column:
    """A photo's score in parts, from the columns of score_significance(); a part that is missing counts as 0."""
    part = lambda n: F.coalesce(F.col(n), F.lit(0.0))
    components = F.struct(*(part(f"{n}_component").alias(n) for n in ("face_presence", "emotion", "intimacy", "engagement")))
    raw = F.struct(F.col("intimacy_score").alias("intimacy"), F.col("engagement_score").alias("engagement"))
    info = F.struct(F.col("face_count").alias("count"), F.col("face_coverage").alias("coverage"))
    return F.struct("composite", "tier", components.alias("components"), raw.alias("raw_scores"), info.alias("face_info"))


def significance_stats(scored: DataFrame, tier: Column, by: list[str] | None = None) -> DataFrame:
    """Count, mean, least and largest composite, photos of each tier, mean faces and photos with faces; one row without groups, whose
    means are null if there are no photos."""
    tiers = [F.count_if(tier == t).alias(t) for t in ("high", "medium", "low")]
    score = F.col("composite")
    return scored.groupBy(*(by or [])).agg(F.count("*").alias("count"), F.avg(score).alias("avg_composite"), F.max(score).alias("max_composite"), F.min(score).alias("min_composite"), *tiers, F.avg("face_count").alias("avg_faces"), F.count_if(F.col("face_count") > 0).alias("with_faces"))
