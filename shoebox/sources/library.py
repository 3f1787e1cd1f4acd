"""Scans of photo libraries: files, ignore rules, validity with reasons, estimates."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from shoebox.config import ScanConfig
from shoebox.operators.ordering import top_per_group


def scan_files(spark: SparkSession, roots: list[str], recursive: bool = True, content: bool = False) -> DataFrame:
    """(path, length, modificationTime, root[, content]) of the files under the roots. A root that doesn't exist has no
    files (missing_roots names those). Content is read only when asked for; it is at most 2 GB a file."""
    parts = []
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for root in roots:
        path = jvm.org.apache.hadoop.fs.Path(root)
        if path.getFileSystem(conf).exists(path):
            files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
            parts.append(files.select("path", "length", "modificationTime", F.lit(root).alias("root"), *(["content"] if content else [])))
    if not parts:
        return spark.createDataFrame([], "path string, length long, modificationTime timestamp, root string" + ", content binary" * content)
    return reduce(DataFrame.unionByName, parts)


def missing_roots(spark: SparkSession, roots: list[str]) -> list[str]:
    """The roots that a scan would find nothing under because they don't exist: its errors."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    there = lambda root: jvm.org.apache.hadoop.fs.Path(root)
    return [r for r in roots if not there(r).getFileSystem(conf).exists(there(r))]


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension(path: Column) -> Column:
    """From the last dot of the name on, in lower case; a dot at its start or end makes none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def ignored_name(name: Column, config: ScanConfig = ScanConfig()) -> Column:
    exact = name.isin(*config.ignore)
    starts = [p[:-1] for p in config.ignore if p.endswith("*")]
    return reduce(lambda a, b: a | b, [exact, *(name.startswith(s) for s in starts)])


def ignored(path: Column, config: ScanConfig = ScanConfig()) -> Column:
    """True if the file or a folder above it is left out: an ignored folder hides all below."""
    return F.exists(F.filter(F.split(path, "/"), lambda s: s != ""), lambda s: ignored_name(s, config))


def skip_reason(path: Column, length: Column, config: ScanConfig = ScanConfig()) -> Column:
    """Why a file is no photo; null if it is one. The first reason counts."""
    reason = F.when(~extension(path).isin(*config.extensions), F.concat(F.lit("wrong_extension_"), extension(path))).when(length.isNull(), "size_check_error").when(length < config.min_bytes, "too_small")
    if config.max_bytes:
        reason = reason.when(length > config.max_bytes, "too_large")
    return reason.when(length == 0, "empty_file")


def scanned(files: DataFrame, config: ScanConfig = ScanConfig()) -> DataFrame:
    """The files that aren't ignored, with their skip_reason."""
    return files.filter(~ignored(F.col("path"), config)).withColumn("skip_reason", skip_reason(F.col("path"), F.col("length"), config))


def photos(files: DataFrame, limit: int | None = None, config: ScanConfig = ScanConfig()) -> DataFrame:
    """The photos among the files; with a limit, the first by path. 0 is no limit."""
    found = scanned(files, config).filter("skip_reason is null").drop("skip_reason")
    return found.orderBy("path").limit(limit) if limit else found


def scan_statistics(files: DataFrame, by: list[str]) -> DataFrame:
    """Files found, skipped, and skipped by reason, for each root."""
    counts = files.groupBy(*by, "skip_reason").agg(F.count("*").alias("n"))
    reasons = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("skip_reason").isNotNull(), F.struct("skip_reason", "n")))))
    return counts.groupBy(*by).agg(F.sum(F.when(F.col("skip_reason").isNull(), F.col("n")).otherwise(0)).alias("found"), F.sum(F.when(F.col("skip_reason").isNotNull(), F.col("n")).otherwise(0)).alias("skipped"), reasons.alias("reasons"))


def validated(paths: DataFrame, files: DataFrame, config: ScanConfig = ScanConfig()) -> DataFrame:
    """Each asked path with the reason why it is no photo, `not_found` and `not_a_file` first."""
    found = files.select("path", "length", "is_dir", F.lit(True).alias("there"))
    joined = paths.join(found, "path", "left")
    reason = F.when(F.col("there").isNull(), "not_found").when(F.col("is_dir"), "not_a_file").otherwise(skip_reason(F.col("path"), F.col("length"), config))
    return joined.select(*paths.columns, reason.alias("reason"))


def split_messages(paths: DataFrame, files: DataFrame) -> DataFrame:
    """Each asked path with a message if it is missing, no file, or empty."""
    joined = paths.join(files.select("path", "length", "is_dir", F.lit(True).alias("there")), "path", "left")
    message = F.when(F.col("there").isNull(), "File not found").when(F.col("is_dir"), "Not a file").when(F.col("length") == 0, "Empty file")
    return joined.select(*paths.columns, message.alias("message"))


def estimated_count(photos: DataFrame, folders: list[str], sample: int = 5, depth: int = 2) -> DataFrame:
    """Photos by the top folder, estimated from at most `sample` subfolders of each folder: own photos, plus the mean of the
    sampled subfolders' estimates times their number, cut to a whole number at each level. Folders `depth` levels
    below the top count with their own photos alone. folders: the columns of a photo's folders from the top on, null below the one
    that it lies in; a column more than depth + 1 marks the photos that lie deeper."""
    depth = min(depth, len(folders) - 1)

    def own(level: int) -> DataFrame:
        here = F.count_if(F.col(folders[level + 1]).isNull()) if level + 1 < len(folders) else F.count("*")
        inside = photos.filter(F.col(folders[level]).isNotNull()) if level else photos
        return inside.groupBy(*folders[: level + 1]).agg(here.alias("estimate"))

    found = own(depth)
    for level in reversed(range(depth)):
        above = folders[: level + 1]
        number = found.groupBy(*above).agg(F.count("*").alias("folders"))
        mean = top_per_group(found, above, [F.col(folders[level + 1])], sample, "place").groupBy(*above).agg(F.avg("estimate").alias("mean"))
        whole = F.col("estimate") + F.coalesce(F.col("mean") * F.col("folders"), F.lit(0.0))
        found = own(level).join(number, above, "left").join(mean, above, "left").select(*above, whole.cast("long").alias("estimate"))
    return found


def collision_free(names: DataFrame, name: str, key: str, span: int = 10_000) -> DataFrame:
    """Adds stored_name, no two of them equal: in the order of key (a number, each once), a row takes its own name if that is free, else
    the first free one of stem_1.suffix, stem_2.suffix and so on.

    Names that can get into each other's way are those of one family: equal but for `_n` at the ends of their stems.
    A family with one distinct name is numbered by counts over ranges of `span` keys, however often the name
    occurs. The others, in which an `a_1.jpg` meets copies of `a.jpg`, are gone through in order, a family to a group.
    """
    stem, suffix = F.regexp_extract(F.col(name), r"^(.+?)(\.[^.]*)?$", 1), F.regexp_extract(F.col(name), r"^.+?(\.[^.]*)?$", 1)
    rows = names.withColumns({"_stem": stem, "_suffix": suffix, "_base": F.regexp_replace(stem, r"(_[1-9][0-9]*)+$", "")})
    families = rows.groupBy("_base", "_suffix").agg(F.min(name).alias("_x"), F.max(name).alias("_y"), F.count("*").alias("_size"))
    mixed = families.filter("_x <> _y and _size > 1").select("_base", "_suffix")
    alone = rows.join(mixed, ["_base", "_suffix"], "left_anti").withColumn("_range", F.floor(F.col(key) / span))
    counts = alone.groupBy(name, "_range").agg(F.count("*").alias("_n"))
    before = W.Window.partitionBy(name).orderBy("_range").rowsBetween(W.Window.unboundedPreceding, -1)
    offsets = counts.select(name, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.row_number().over(W.Window.partitionBy(name, "_range").orderBy(key)) - 1
    numbered = alone.join(offsets, [name, "_range"]).withColumn("_place", place)
    numbered = numbered.withColumn("stored_name", F.when(F.col("_place") == 0, F.col(name)).otherwise(F.concat("_stem", F.lit("_"), F.col("_place").cast("string"), "_suffix")))

    kept = names.columns

    def in_order(family: pd.DataFrame) -> pd.DataFrame:
        family, taken, tried, out = family.sort_values(key), set(), {}, []
        for wanted, head, tail in zip(family[name], family["_stem"], family["_suffix"], strict=True):
            free = wanted
            while free in taken:
                tried[wanted] = tried.get(wanted, 0) + 1  # lower numbers are taken for good
                free = f"{head}_{tried[wanted]}{tail}"
            taken.add(free)
            out.append(free)
        return family[kept].assign(stored_name=out)

    schema = T.StructType([*names.schema.fields, T.StructField("stored_name", T.StringType())])
    together = rows.join(mixed, ["_base", "_suffix"], "left_semi").groupBy("_base", "_suffix").applyInPandas(in_order, schema)
    return numbered.select(*names.columns, "stored_name").unionByName(together)


# Content types by extension.
CONTENT_TYPES = {".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".heic": "image/heic", ".heif": "image/heif"}


def content_type(path: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in CONTENT_TYPES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, extension(path)), F.lit("application/octet-stream"))
