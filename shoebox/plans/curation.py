"""Whole plans: from photos to selections and reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from shoebox.config import Settings
from shoebox.functions import dates, decode, faces, pixels, quality
from shoebox.operators import curate, diversity
from shoebox.sources import exif, library, media, walk


def score_quality(images: DataFrame, settings: Settings = Settings(), key: str = "origin") -> DataFrame:
    """Adds sharpness, exposure, composite and tier to images; the pixel kernel runs once for each image."""
    found = pixels.pixel_scores(images, key, settings.quality.max_side)
    composite = quality.quality_score(F.col("sharpness"), F.col("exposure"), settings.quality)
    return found.withColumn("composite", composite).withColumn("tier", quality.quality_tier(F.col("composite")))


def curate_years(photos: DataFrame, settings: Settings = Settings(), by: tuple[str, ...] = ("year",)) -> DataFrame:
    """The selection of every group in one plan: photos (by..., photo_id, month, quality, emotional, face_count) in final order."""
    scored = curate.combined(photos, settings.curation)
    return curate.final_order(curate.selected(scored, list(by), settings.curation), list(by))


def photo_dates(files: DataFrame) -> DataFrame:
    """Rows (path, exif, taken) of files with content: the date of the first EXIF field that is there, and the date that counts."""
    texts = exif.exif_texts(files)
    when = dates.exif_datetime(dates.first_present(F.col("original"), F.col("plain"), F.col("digitized")))
    return files.select("path", "modificationTime").join(texts, "path").select("path", when.alias("exif"), dates.photo_datetime(when, F.col("modificationTime").cast("timestamp_ntz")).alias("taken"))


#: What a picture gives in one pass over its bytes. decoded: false where no decoder takes the format.
PASSED = f"path string, taken timestamp_ntz, width int, height int, decoded boolean, {pixels.MEASURES}, faces array<struct<x:int,y:int,w:int,h:int,smile:double>>, error string"
Decoder = Callable[[bytes], np.ndarray]


def one_pass(files: DataFrame, year: int, decoders: dict[str, Decoder] | None = None, detector: Callable | None = None, settings: Settings = Settings(), slice_bytes: int = 64 << 20) -> DataFrame:
    """Rows PASSED of files (path, modificationTime, content) of the year, and of undated ones: each file's bytes are read once, in one task.

    The date comes first: files of other years are dropped before anything is decoded. decoders are functions from bytes to an
    array (height, width, channels; BGR), by extension; PNG has one already. A picture that its decoder or the measures fail for has nulls and
    the error's text. The detector gets decoded pictures as detect_faces gives them, at most slice_bytes of pixels at once.
    """
    known = {".png": decode.decoded_png, **(decoders or {})}
    names = [c.split()[0] for c in pixels.MEASURES.split(", ")]
    columns = ["path", "taken", "width", "height", "decoded", *names, "faces", "error"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows, waiting, size = [], [], 0
            for path, when, content in zip(frame["path"], frame["modificationTime"], frame["content"], strict=True):
                taken = dates.taken(*exif.date_texts(content)[:3], None if pd.isna(when) else when.to_pydatetime())
                if taken is not None and taken.year != year:
                    continue
                at = path.rfind(".")
                decoder = known.get(path[at:].lower()) if at > path.rfind("/") else None
                found = dict.fromkeys(names) | {"path": path, "taken": taken, "decoded": decoder is not None, "faces": [] if detector is None else None}
                try:
                    if decoder:
                        image = decoder(content)
                        found |= {"height": image.shape[0], "width": image.shape[1]} | dict(zip(names, pixels.measures(image, settings.quality.max_side), strict=True))
                        if detector is not None:
                            waiting.append((len(rows), {"origin": path, "data": image.tobytes(), "height": image.shape[0], "width": image.shape[1], "nChannels": image.shape[2]}))
                            size += image.nbytes
                except Exception as e:  # noqa: BLE001  one photo must not end the scan
                    found |= dict.fromkeys(names) | {"error": f"{type(e).__name__}: {e}"}
                rows.append(found)
                if size > slice_bytes:
                    detected(rows, waiting)
                    waiting, size = [], 0
            detected(rows, waiting)
            yield pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in columns})

    def detected(rows: list[dict], waiting: list[tuple[int, dict]]) -> None:
        if waiting:
            found, errors = faces.bisected(detector, pd.DataFrame([photo for _, photo in waiting]))
            for (place, _), some, error in zip(waiting, found, errors, strict=True):
                rows[place] |= {"faces": None if some is None else [{c: f[c] for c in ("x", "y", "w", "h", "smile")} for f in some], "error": rows[place].get("error") or error}

    utc = F.col("modificationTime").cast("timestamp_ntz").alias("modificationTime")
    return files.select("path", utc, "content").mapInPandas(run, PASSED)


def curated(passed: DataFrame, year: int, settings: Settings = Settings()) -> DataFrame:
    """The selection of a year from the rows of one_pass: (year, photo_id, month, quality, emotional, face_count) in final order. Photos with an error, or whose format
    nothing decoded, take no part."""
    found = pixels.scores(passed.filter("error is null and decoded"))
    found = found.withColumn("quality", quality.quality_score(F.col("sharpness"), F.col("exposure"), settings.quality))
    human = faces.score_significance(found, settings.emotional)
    photos = human.select(F.col("path").alias("photo_id"), F.lit(year).alias("year"), F.month("taken").cast("long").alias("month"), "quality", F.col("composite").alias("emotional"), "face_count")
    return curate_years(photos, settings)


def curate_folder(spark: SparkSession, roots: list[str], year: int, detector: Callable | None = None, settings: Settings = Settings(), decoders: dict[str, Decoder] | None = None) -> DataFrame:
    """From files to the selection of a year. A photo's date is that of its EXIF fields, or else of its file; undated photos
    pass. Without a detector no photo has faces.

    With decoders (an empty dict is enough for libraries of PNG) the files are scanned once, and each picture of the year is decoded in the task that
    read it. Without them JPEG is decoded by Spark's image source, which reads the files again.
    """
    there = [r for r in roots if r not in library.missing_roots(spark, roots)]
    if not there:
        raise FileNotFoundError(f"no such folders: {', '.join(roots)}")
    files = library.photos(library.scan_files(spark, there, content=True), config=settings.scan)
    if decoders is not None:
        return curated(one_pass(files, year, decoders, detector, settings), year, settings)
    files = photo_dates(files).filter(dates.in_year_or_undated(F.col("taken"), F.lit(year)))
    images = spark.read.format("image").option("recursiveFileLookup", "true").load(there).select("image.*")
    images = images.withColumn("origin", F.regexp_replace("origin", "^file:/+", "file:/"))  # local paths as file scans write them
    wanted = images.join(files.select(F.col("path").alias("origin"), "taken"), "origin").filter("height > 0")
    scored = score_quality(wanted, settings)
    if detector is None:
        found = wanted.select("origin", F.array().cast("array<struct<x:int,y:int,w:int,h:int,smile:double>>").alias("faces"), "width", "height", "taken")
    else:
        found = faces.detect_faces(wanted, detector, "origin").join(wanted.select("origin", "width", "height", "taken"), "origin")
    human = faces.score_significance(found, settings.emotional).select("origin", F.col("composite").alias("emotional"), "face_count", "taken")
    photos = scored.filter("error is null").join(human, "origin").select(F.col("origin").alias("photo_id"), F.lit(year).alias("year"), F.month("taken").cast("long").alias("month"), F.col("composite").alias("quality"), "emotional", "face_count")
    return curate_years(photos, settings)


def curate_listing(items: DataFrame, folder: str, year: int, fetch: Callable[[str], bytes], decoders: dict[str, Decoder] | None = None, detector: Callable | None = None, settings: Settings = Settings(), clean: bool = True) -> list[Row]:
    """From a listing (id, filename, baseUrl, productUrl, creationTime, ...) to the twelve photos of a year, with their address in the service: items of
    other years are left out before anything is fetched, the others are stored under the folder (what is there already isn't fetched again), scored from their
    bytes and selected. An item's own creation time is its date. Unless clean is false, the stored files are deleted at the end, whether or not it succeeded;
    so the selection is what is returned, twelve rows at most."""
    spark, table = items.sparkSession, walk.shared_folder(items.sparkSession)
    when = F.try_to_timestamp(F.col("creationTime")).cast("timestamp_ntz")
    wanted = items.withColumn("taken", when).filter(dates.in_year_or_undated(F.col("taken"), F.lit(year)))
    try:
        media.stored(wanted.withColumn("url", media.download_url(F.col("baseUrl"))), folder, fetch).write.parquet(table)
        there = spark.read.schema(media.STORED).parquet(table).filter("error is null").join(wanted.select("id", "filename", "taken", "productUrl"), "id")
        files = media.stored_files(spark, folder).join(there, "path")
        named = files.select(F.concat("id", F.lit("/"), "filename").alias("path"), F.col("taken").alias("modificationTime"), "content")
        chosen = curated(one_pass(named, year, decoders, detector, settings), year, settings)
        address = there.select(F.concat("id", F.lit("/"), "filename").alias("photo_id"), "productUrl")
        return chosen.join(address, "photo_id", "left").orderBy("place").collect()
    finally:
        media.cleaned(spark, table)
        if clean:
            media.cleaned(spark, folder)


def image_similarity(images: DataFrame, album: str = "album", key: str = "origin", order: str = "place", settings: Settings = Settings()) -> DataFrame:
    """(album, first, second, similarity) of the pairs of each album by their colours: the mean correlation of the hue, saturation and
    value histograms. Images that can't be read compare as 0."""
    found = pixels.measure_pixels(images, key, settings.quality.max_side).select(key, F.coalesce("histogram", F.array().cast("array<double>")).alias("histogram"))
    placed = images.select(album, order, key).join(found, key)
    return diversity.similarity_pairs(placed, album, key, "histogram", order, pixels.HSV_BINS)
