"""Quality scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shoebox.config import QualityConfig


def clamped(score: Column) -> Column:
    """Null stays null: greatest() and least() would skip it."""
    return F.when(score.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)))


def banded(score: Column, names: tuple[str, ...], limits: tuple[float, ...]) -> Column:
    """names[0] below limits[0], names[1] below limits[1], ... and the last name from the last limit on."""
    out = F.lit(names[-1])
    for name, limit in reversed(list(zip(names, limits, strict=False))):
        out = F.when(score < limit, name).otherwise(out)
    return F.when(score.isNotNull(), out)


def sharpness_tier(score: Column) -> Column:
    return banded(score, ("very_blurry", "slightly_blurry", "adequate", "sharp"), (30, 50, 70))


def exposure_tier(score: Column) -> Column:
    return banded(score, ("severe", "poor", "acceptable", "well_exposed"), (30, 50, 70))


def quality_tier(score: Column) -> Column:
    """The limits are fixed, whatever a configuration says."""
    return banded(score, ("low", "acceptable", "high"), (50, 70))


def quality_score(sharpness: Column, exposure: Column, config: QualityConfig = QualityConfig()) -> Column:
    """The weighted mean; raises for input outside 0 to 100."""
    wrong = ~sharpness.between(0, 100) | ~exposure.between(0, 100)
    score = clamped(sharpness * F.lit(float(config.sharpness)) + exposure * F.lit(float(config.exposure)))
    return F.when(wrong, F.raise_error(F.lit("scores lie between 0 and 100")).cast("double")).otherwise(score)


def points_to(score: Column, limit: float) -> Column:
    """How far a score lies below a tier's limit."""
    return F.greatest(F.lit(0.0), F.lit(float(limit)) - score)


def compared(first: Column, second: Column) -> Column:
    """Which of two quality scores is better; under a tenth of a point they count as equal."""
    return F.when(F.abs(first - second) < 0.1, "equal").when(first > second, "score1").otherwise("score2")


def tier_change(first: Column, second: Column) -> Column:
    return F.when(first != second, F.concat(first, F.lit(" -> "), second))


def compared_emotional(first: Column, second: Column) -> Column:
    return F.when(first > second, "first").when(second > first, "second").otherwise("tie")


def exposure_score(clipped: Column, crushed: Column, middle: Column) -> Column:
    """From the shares of pixels that are clipped, crushed and of middle tone."""
    return clamped(F.lit(100.0) - clipped * 100 - crushed * 100 + middle * 50)


def exposure_issues(clipped: Column, crushed: Column, deviation: Column, limit: float = 0.05) -> Column:
    return F.array_compact(F.array(F.when(clipped > limit, "overexposed"), F.when(crushed > limit, "underexposed"), F.when(deviation < 30, "low_contrast")))


def score_bar(score: Column, width: int = 30) -> Column:
    # The colours of the bands.
    filled = F.floor(score * width / 100).cast("int")
    colour = F.when(score >= 70, "🟩").when(score >= 50, "🟨").otherwise("🟥")
    return F.concat(F.repeat(colour, filled), F.repeat(F.lit("⬜"), F.lit(width) - filled))


def face_points(count: Column) -> Column:
    """The coarse points that reports print; scoring uses face_presence()."""
    return F.when(count == 0, 0).when(count == 1, 20).when(count == 2, 25).otherwise(30)
