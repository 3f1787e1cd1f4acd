"""Walks over folders by rounds: a folder that is left out is never listed, and a walk ends once it has found enough.

Each round lists the folders of the frontier in tasks; what it finds is a table in the shared folder, and the folders in it
that aren't left out are the next frontier. Only counts reach the driver. A lister names the entries of one folder;
the default one reads whatever pyarrow's file systems read (local, HDFS, object stores).
"""

from __future__ import annotations

import datetime as dt
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoebox.config import ScanConfig

from .library import ignored_name, skip_reason


@dataclass(frozen=True)
class Entry:
    """What lies in a folder. modified: seconds since 1970."""

    name: str
    is_dir: bool
    length: int = 0
    modified: float | None = None


Lister = Callable[[str], list[Entry]]
ENTRY = "path string, name string, is_dir boolean, length long, modificationTime timestamp, error string, depth int"


def listed(folder: str) -> list[Entry]:
    """The entries of a folder, given as a path or an address, by pyarrow. Raises OSError if it can't be read."""
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    found = files.get_file_info(fs.FileSelector(path, recursive=False))
    return [Entry(x.base_name, x.type == fs.FileType.Directory, x.size or 0, x.mtime.timestamp() if x.mtime else None) for x in found]


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share: under spark.checkpoint.dir, or, for a local session without it, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(base or tempfile.gettempdir() + '/shoebox-shared').rstrip('/')}/walk-{uuid.uuid4().hex}"


def walked(spark: SparkSession, roots: list[str], lister: Lister = listed, config: ScanConfig = ScanConfig(), limit: int | None = None, deepest: int = 64) -> DataFrame:
    """Rows ENTRY of all that lies under the roots, but for entries that are left out by name: those are not shown, and such folders are
    never listed. A folder that can't be listed (a root that isn't there, too) has one row with its own path and the error. depth: 0 for what lies in a root.

    With a limit, no deeper folders are listed once so many photos have been found (0 and None: no limit). Links that lead back
    up end at `deepest` levels.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for folder in frame["path"]:
                try:
                    for e in sorted(lister(folder), key=lambda e: e.name):
                        when = None if e.modified is None else dt.datetime.fromtimestamp(e.modified, dt.UTC).replace(tzinfo=None)
                        rows.append((f"{folder.rstrip('/')}/{e.name}", e.name, e.is_dir, e.length, when, None))
                except Exception as error:  # noqa: BLE001  one folder must not end the walk
                    rows.append((folder, folder.rstrip("/").rsplit("/", 1)[-1], True, 0, None, f"{type(error).__name__}: {error}"))
            out = pd.DataFrame(rows, columns=["path", "name", "is_dir", "length", "modificationTime", "error"])
            out["modificationTime"] = pd.to_datetime(out["modificationTime"])
            yield out

    folder, found, depth, tables = shared_folder(spark), 0, 0, []
    frontier = spark.createDataFrame([(r,) for r in dict.fromkeys(roots)], "path string")
    while depth < deepest:
        # each folder is a row, dealt by its path: a large folder is one listing, many small ones are spread
        entries = frontier.repartition("path").mapInPandas(run, ENTRY.rsplit(",", 1)[0]).withColumn("depth", F.lit(depth))
        entries.filter(F.col("error").isNotNull() | ~ignored_name(F.col("name"), config)).write.parquet(f"{folder}/{depth}")
        table = spark.read.schema(ENTRY).parquet(f"{folder}/{depth}")
        tables.append(f"{folder}/{depth}")
        more = table.filter("is_dir and error is null")
        if limit:
            found += table.filter("not is_dir").filter(skip_reason(F.col("path"), F.col("length"), config).isNull()).count()
            if found >= limit:
                break
        if not more.limit(1).count():
            break
        frontier, depth = more.select("path"), depth + 1
    return spark.read.schema(ENTRY).parquet(*tables)


def walked_photos(spark: SparkSession, roots: list[str], lister: Lister = listed, config: ScanConfig = ScanConfig(), limit: int | None = None) -> DataFrame:
    """(path, length, modificationTime) of the photos under the roots; with a limit so many of them, the less deep first, then by path."""
    files = walked(spark, roots, lister, config, limit).filter("not is_dir")
    photos = files.filter(skip_reason(F.col("path"), F.col("length"), config).isNull())
    photos = photos.orderBy("depth", "path").limit(limit) if limit else photos
    return photos.select("path", "length", "modificationTime")


def walk_errors(entries: DataFrame) -> DataFrame:
    """(path, error) of the folders that couldn't be listed."""
    return entries.filter("error is not null").select("path", "error")


def quick_estimate(root: str, lister: Lister = listed, config: ScanConfig = ScanConfig(), sample: int = 5, depth: int = 2) -> int:
    """About how many photos lie under a root, from at most 1 + sample + sample² listings (for depth 2): its own photos, plus the mean of
    its first subfolders' estimates by name times their number, cut to a whole number at each level. Folders that can't be listed count as empty."""
    extensions, prefixes = set(config.extensions), tuple(p[:-1] for p in config.ignore if p.endswith("*"))
    hidden = lambda name: name in config.ignore or bool(prefixes and name.startswith(prefixes))

    def is_photo(e: Entry) -> bool:
        at = e.name.rfind(".")
        fits = 0 < at < len(e.name) - 1 and e.name[at:].lower() in extensions
        return fits and e.length >= config.min_bytes and (not config.max_bytes or e.length <= config.max_bytes)

    try:
        entries = [e for e in lister(root) if not hidden(e.name)]
    except Exception:  # noqa: BLE001
        return 0
    own, folders = sum(is_photo(e) for e in entries if not e.is_dir), sorted(e.name for e in entries if e.is_dir)
    if depth == 0 or not folders:
        return own
    some = [quick_estimate(f"{root.rstrip('/')}/{name}", lister, config, sample, depth - 1) for name in folders[:sample]]
    return int(own + sum(some) / len(some) * len(folders))
