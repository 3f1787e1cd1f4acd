"""Dates of photos: EXIF text, file times, and what is derived from them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def exif_datetime(text: Column) -> Column:
    """`2024:06:15 14:30:45` or `2024:06:15`; null for anything else."""
    when = F.coalesce(F.try_to_timestamp(text, F.lit("yyyy:MM:dd HH:mm:ss")), F.try_to_timestamp(text, F.lit("yyyy:MM:dd")))
    return when.cast("timestamp_ntz")


def first_present(original: Column, plain: Column, digitized: Column) -> Column:
    """The EXIF text to parse: the first field that is there, even if it can't be parsed."""
    return F.coalesce(original, plain, digitized)


def photo_datetime(exif: Column, file_time: Column) -> Column:
    return F.coalesce(exif, file_time)


def in_year(when: Column, year: Column) -> Column:
    """Strict: an undated photo is from no year."""
    return F.coalesce(F.year(when) == year, F.lit(False))


def in_year_or_undated(when: Column, year: Column) -> Column:
    return when.isNull() | (F.year(when) == year)


def datetime_info(exif: Column, file_time: Column) -> Column:
    when = photo_datetime(exif, file_time)
    return F.struct(when.alias("datetime"), F.month(when).cast("long").alias("month"), F.year(when).cast("long").alias("year"), F.when(exif.isNotNull(), "exif").otherwise("file_mtime").alias("source"), exif.alias("exif"), file_time.alias("file_mtime"))


def date_texts(when: Column) -> Column:
    """The texts that a date is shown as: June, Jun 15 and 2024-06-15; null for an undated photo."""
    return F.struct(F.date_format(when, "MMMM").alias("month_name"), F.date_format(when, "MMM dd").alias("day"), F.date_format(when, "yyyy-MM-dd").alias("date"))


def taken(original: str | None, plain: str | None, digitized: str | None, file_time: dt.datetime | None) -> dt.datetime | None:
    """photo_datetime(exif_datetime(first_present(...))) of one file, for kernels that have its bytes."""
    text = next((x for x in (original, plain, digitized) if x is not None), None)
    form = {19: "%Y:%m:%d %H:%M:%S", 10: "%Y:%m:%d"}.get(len(text or ""))
    try:
        return dt.datetime.strptime(text, form) if form else file_time
    except ValueError:
        return file_time
