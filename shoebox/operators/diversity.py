"""How alike photos of one selection are. Pairs are formed inside a selection (an album of a few photos), never across."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoebox.functions.faces import bound


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def product(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda u, v: u * v))


def unit(a: Column) -> Column:
    """The array moved to mean 0 and scaled to length 1, so that a product of two is their correlation; nulls for a constant one; an empty one stays empty."""

    def scaled(x: Column) -> Column:
        return bound(F.sqrt(product(x, x)), lambda n: F.transform(x, lambda v: F.when(n > 0, v / n)))

    return bound(F.try_divide(total(a), F.size(a)), lambda mean: bound(F.transform(a, lambda v: v - mean), scaled))


def units(a: Column, channels: tuple[int, ...] = ()) -> Column:
    """unit() of the whole array, or of each channel (their lengths, in order)."""
    return F.concat(*(unit(F.slice(a, s, n)) for s, n in parts(channels))) if channels else unit(a)


def parts(channels: tuple[int, ...]) -> list[tuple[int, int]]:
    """The start and length of each channel in an array that holds all."""
    return [(sum(channels[:i]) + 1, n) for i, n in enumerate(channels)]


def correlation(a: Column, b: Column) -> Column:
    """Pearson's, of two arrays of the same length; null if one is constant."""
    return product(unit(a), unit(b))


def alike(x: Column, y: Column, channels: tuple[int, ...] = ()) -> Column:
    """The similarity of two units(): the mean correlation over channels, moved to 0 to 1. A channel without variance in
    one of the two correlates at 1; arrays of different lengths, and empty ones, can't be compared (null)."""
    each = [F.coalesce(product(F.slice(x, s, n), F.slice(y, s, n)), F.lit(1.0)) for s, n in parts(channels)] if channels else [F.coalesce(product(x, y), F.lit(1.0))]
    mean = sum(each[1:], each[0]) / len(each)
    return F.when((F.size(x) == F.size(y)) & (F.size(x) > 0), bound(mean, lambda m: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (m + 1) / 2))))


def similarity(a: Column, b: Column, channels: tuple[int, ...] = ()) -> Column:
    return alike(units(a, channels), units(b, channels), channels)


def album_arrays(photos: DataFrame, album: str, key: str, histogram: str, order: str, channels: tuple[int, ...] = ()) -> DataFrame:
    """(album, items array<struct<order, key, units>>): an album's photos in order, each scaled once. An album is a selection of
    bounded size; that is the caller's promise."""
    item = F.struct(F.col(order).alias("o"), F.col(key).alias("k"), units(F.col(histogram), channels).alias("h"))
    return photos.groupBy(album).agg(F.array_sort(F.collect_list(item)).alias("items"))


def similarity_pairs(photos: DataFrame, album: str = "album", key: str = "photo_id", histogram: str = "histogram", order: str = "place", channels: tuple[int, ...] = ()) -> DataFrame:
    """(album, first, second, similarity) of the pairs of each album, the earlier photo first; a pair that can't be
    compared counts as 0."""
    items = album_arrays(photos, album, key, histogram, order, channels)
    later = lambda a, i: F.transform(F.slice(F.col("items"), i + 2, F.size("items")), lambda b: F.struct(a["k"].alias("first"), b["k"].alias("second"), F.coalesce(alike(a["h"], b["h"], channels), F.lit(0.0)).alias("similarity")))
    return items.select(album, F.inline(F.flatten(F.transform("items", later))))


def similarity_matrix(pairs: DataFrame, photos: DataFrame, album: str = "album", key: str = "photo_id") -> DataFrame:
    """The pairs both ways, and each photo with itself at 1."""
    mirrored = pairs.select(album, F.col("second").alias("first"), F.col("first").alias("second"), "similarity")
    own = photos.select(album, F.col(key).alias("first"), F.col(key).alias("second"), F.lit(1.0).alias("similarity"))
    return pairs.unionByName(mirrored).unionByName(own)


def is_diverse(value: Column, threshold: float = 0.85) -> Column:
    """What can't be compared counts as diverse."""
    return F.coalesce(value < threshold, F.lit(True))


def diversity_stats(pairs: DataFrame, albums: DataFrame, album: str = "album", threshold: float = 0.85) -> DataFrame:
    """Mean, least and largest similarity, 1 - mean, and pairs above the threshold; an album without pairs has 0, 0, 0, 1 and 0."""
    found = pairs.groupBy(album).agg(F.avg("similarity").alias("avg_similarity"), F.min("similarity").alias("min_similarity"), F.max("similarity").alias("max_similarity"), F.count_if(F.col("similarity") > threshold).alias("similar_pairs"))
    out = albums.select(album).distinct().join(found, album, "left").fillna(0.0, ["avg_similarity", "min_similarity", "max_similarity"]).fillna(0, ["similar_pairs"])
    return out.withColumn("diversity", 1 - F.col("avg_similarity"))


def mean_similarity(photos: DataFrame, by: list[str], histogram: str = "histogram", channels: tuple[int, ...] = ()) -> DataFrame:
    """(by..., photos, avg_similarity) of groups of any size, equal to the mean over similarity_pairs(), without a pair.

    The products of all pairs of unit vectors are half of what the square of their sum has beyond their own squares; pairs with a constant
    channel are counted apart, at 1; photos of different lengths, and those without a histogram or with an empty one, compare as 0. A group of one photo has null.
    """
    pairs = lambda n: n * (n - 1) / 2
    # place 0 stands for the photo itself, so that those without a histogram are counted in the same pass
    values = F.concat(F.array(F.lit(None).cast("double")), F.coalesce(units(F.col(histogram), channels), F.array().cast("array<double>")))
    spread = photos.select(*by, F.coalesce(F.size(histogram), F.lit(0)).alias("_size"), F.posexplode(values).alias("_at", "_v"))
    sums = spread.groupBy(*by, "_size", "_at").agg(F.sum("_v").alias("s"), F.sum(F.col("_v") * F.col("_v")).alias("q"), F.count("_v").alias("varied"), F.count("*").alias("n"))
    ends = [sum(channels[: i + 1]) for i in range(len(channels))]
    channel = F.when(F.col("_at") == 0, -1).otherwise(sum((F.when(F.col("_at") > end, 1).otherwise(0) for end in ends), F.lit(0)))
    each = sums.groupBy(*by, "_size", channel.alias("_channel")).agg(F.coalesce(F.sum(F.col("s") * F.col("s") - F.col("q")) / 2, F.lit(0.0)).alias("products"), F.max("varied").alias("varied"), F.max("n").alias("n"))
    alike = (F.col("products") + 2 * pairs(F.col("n")) - pairs(F.col("varied"))) / (2 * max(1, len(channels)))
    found = each.groupBy(*by).agg(F.sum(F.when(F.col("_channel") < 0, F.col("n"))).alias("photos"), F.sum(F.when(F.col("_channel") >= 0, alike).otherwise(0.0)).alias("_alike"))
    mean = F.when(F.col("photos") > 1, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_alike") / pairs(F.col("photos")))))
    return found.select(*by, "photos", mean.alias("avg_similarity"))


def without_similar(photos: DataFrame, album: str = "album", key: str = "photo_id", histogram: str = "histogram", order: str = "place", threshold: float = 0.85) -> DataFrame:
    """(album, photo, position): photos in order, without those at or above the threshold to one kept before. A fold
    over the album's array whose state is the kept photos."""
    items = album_arrays(photos, album, key, histogram, order)
    empty = F.slice(F.col("items"), 1, 0)
    near = lambda kept, x: F.exists(kept, lambda y: F.coalesce(alike(x["h"], y["h"]), F.lit(0.0)) >= threshold)
    kept = F.aggregate("items", empty, lambda s, x: F.when(near(s, x), s).otherwise(F.concat(s, F.array(x))))
    return items.select(album, F.posexplode(F.transform(kept, lambda x: x["k"])).alias("position", "photo"))


def most_diverse(photos: DataFrame, count: int, album: str = "album", key: str = "photo_id", histogram: str = "histogram", order: str = "place") -> DataFrame:
    """(album, photo, position): the first photo, then again and again the one whose least similarity to the chosen
    is lowest, the earliest of equals; at most `count` of each album."""
    items = album_arrays(photos, album, key, histogram, order)
    score = lambda x, s: F.array_min(F.transform(s, lambda y: F.coalesce(alike(x["h"], y["h"]), F.lit(0.0))))

    def step(s: Column, _: Column) -> Column:
        rest = F.filter(F.col("items"), lambda x: ~F.exists(s, lambda y: y["o"] == x["o"]))
        best = F.array_min(F.transform(rest, lambda x: F.struct(score(x, s).alias("v"), x["o"].alias("o"), x.alias("x"))))
        return F.when(F.size(rest) > 0, F.concat(s, F.array(best["x"]))).otherwise(s)

    chosen = F.aggregate(F.array_repeat(F.lit(0), max(0, count - 1)), F.slice(F.col("items"), 1, 1), step)
    # an album that is small enough keeps its order
    chosen = F.when(F.size("items") <= count, F.col("items")).otherwise(chosen)
    return items.select(album, F.posexplode(F.transform(chosen, lambda x: x["k"])).alias("position", "photo"))
