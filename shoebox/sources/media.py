"""Cloud listings: pages of media items, their metadata, and a data source that reads them by month."""

from __future__ import annotations

import datetime as dt
import hashlib
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, InputPartition, LessThanOrEqual

from shoebox.schemas import MEDIA_PAGE

# Formats by MIME type.
FORMATS = {"image/jpeg": "jpg", "image/png": "png", "image/heic": "heic", "image/heif": "heif"}


class SourceError(Exception):
    """A source can't be read."""


class AuthenticationError(SourceError):
    """Access was refused."""


class RateLimitError(SourceError):
    """Too many requests; retry_after has the seconds to wait, if known."""

    def __init__(self, message: str, retry_after: int | None = None) -> None:
        super().__init__(message)
        self.retry_after = retry_after


class DownloadError(SourceError):
    """A photo could not be fetched."""


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Media items of saved listing pages (JSON); items without a base URL are left out."""
    pages = spark.read.schema(MEDIA_PAGE).json(path, multiLine=True)
    return pages.select(F.inline("mediaItems")).filter(F.coalesce(F.length("baseUrl"), F.lit(0)) > 0)


def download_url(base: Column) -> Column:
    return F.concat(base, F.lit("=d"))


def item_metadata(items: DataFrame) -> DataFrame:
    """Adds timestamp, month, format, width and height; an unknown MIME type counts as jpg, a missing size as 0."""
    known = F.create_map(*(F.lit(x) for pair in FORMATS.items() for x in pair))
    side = lambda n: F.coalesce(F.col(f"mediaMetadata.{n}").try_cast("int"), F.lit(0))
    when = F.try_to_timestamp(F.col("mediaMetadata.creationTime"))
    return items.withColumns({"timestamp": when, "format": F.coalesce(F.try_element_at(known, F.col("mimeType")), F.lit("jpg")), "width": side("width"), "height": side("height"), "url": download_url(F.col("baseUrl"))}).withColumn("month", F.month("timestamp"))


def checked(status: int, message: str = "", retry_after: int | None = None) -> None:
    """Raises the error that an HTTP status stands for; returns for a success."""
    if status in (401, 403):
        raise AuthenticationError(message or f"status {status}")
    if status == 429:
        raise RateLimitError(message or "too many requests", retry_after)
    if status >= 400:
        raise SourceError(message or f"status {status}")


class Month(InputPartition):
    """The days of one month; without bounds the undated items."""

    def __init__(self, start: str | None, end: str | None) -> None:
        self.start, self.end = start, end


class ListingReader(DataSourceReader):
    """Reads the items of a date range, a partition for each month, and the undated ones if no range is asked for. A subclass
    supplies page(), which asks a service."""

    def __init__(self, options: dict) -> None:
        self.options = options
        self.whole = "start" not in options and "end" not in options
        self.size = int(options.get("pageSize", "100"))
        self.start = dt.date.fromisoformat(options.get("start", "1990-01-01"))
        self.end = dt.date.fromisoformat(options["end"]) if "end" in options else dt.date.today()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds on `day` narrow the range that is asked for; all filters are also kept for Spark."""
        for f in filters:
            if getattr(f, "attribute", None) == ("day",):
                if isinstance(f, (GreaterThanOrEqual, EqualTo)):
                    self.start, self.whole = max(self.start, f.value), False
                if isinstance(f, (LessThanOrEqual, EqualTo)):
                    self.end, self.whole = min(self.end, f.value), False
            yield f

    def partitions(self) -> list[InputPartition]:
        out, at = [], self.start
        while at <= self.end:
            after = (at.replace(day=1) + dt.timedelta(days=32)).replace(day=1)
            out.append(Month(at.isoformat(), min(self.end, after - dt.timedelta(days=1)).isoformat()))
            at = after
        return [*out, *([Month(None, None)] if self.whole else [])] or [Month(self.start.isoformat(), self.end.isoformat())]

    def page(self, start: str | None, end: str | None, token: str | None, size: int) -> dict:
        """One listing page of at most size items after the token: {"mediaItems": [...], "nextPageToken": ...}. start and end are
        days; both None: undated items. Raises what checked() raises."""
        raise NotImplementedError

    def read(self, partition: Month) -> Iterator[tuple]:
        token = None
        while True:
            found = self.page(partition.start, partition.end, token, self.size)
            for x in found.get("mediaItems", []):
                if x.get("baseUrl"):
                    created = x.get("mediaMetadata", {}).get("creationTime")
                    yield x.get("id"), x.get("filename"), x["baseUrl"], x.get("productUrl"), x.get("mimeType"), created, dt.date.fromisoformat(created[:10]) if created else None
            token = found.get("nextPageToken")
            if not token:
                return


class MediaListing(DataSource):
    """A listing service as a data source: a subclass names its reader, and is registered under its name()."""

    reader_class: type[ListingReader] = ListingReader

    @classmethod
    def name(cls) -> str:
        return "media_listing"

    def schema(self) -> str:
        return "id string, filename string, baseUrl string, productUrl string, mimeType string, creationTime string, day date"

    def reader(self, schema) -> DataSourceReader:
        return self.reader_class(self.options)


def saved_listing(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """The items of saved listing pages, one JSON page a line, in the layout of a listing source. With a bound, undated items are left out."""
    items = spark.read.schema(MEDIA_PAGE).json(path).select(F.inline("mediaItems")).filter(F.coalesce(F.length("baseUrl"), F.lit(0)) > 0)
    created = F.col("mediaMetadata.creationTime")
    out = items.select("id", "filename", "baseUrl", "productUrl", "mimeType", created.alias("creationTime"), F.try_to_date(F.substring(created, 1, 10), "yyyy-MM-dd").alias("day"))
    for bound in ([F.col("day") >= F.lit(start)] if start else []) + ([F.col("day") <= F.lit(end)] if end else []):
        out = out.filter(bound)
    return out


def fetched(items: DataFrame, fetch: Callable[[str], bytes], url: str = "url", key: str = "id") -> DataFrame:
    """Rows (key, content, error) for each item: what fetch gives for its URL. An item that fails with DownloadError is skipped: its content
    is null and error says why. Other errors (refused access, too many requests) end the job, as every item would meet them."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for address in frame[url]:
                try:
                    rows.append((fetch(address), None))
                except DownloadError as e:
                    rows.append((None, str(e)))
            out = pd.DataFrame(rows, columns=["content", "error"])
            out.insert(0, key, frame[key].to_numpy())
            yield out

    return items.select(key, url).mapInPandas(run, f"{key} {items.schema[key].dataType.simpleString()}, content binary, error string")


STORED = "id string, path string, length long, sha256 string, error string"


def _waiting(fetch: Callable[[str], bytes], address: str, tries: int, pause: float) -> bytes:
    """fetch(address), again after RateLimitError: after as many seconds as it asks for, or twice as long each time."""
    for turn in range(tries):
        try:
            return fetch(address)
        except RateLimitError as e:
            if turn == tries - 1:
                raise
            time.sleep(pause * 2**turn if e.retry_after is None else e.retry_after)
    raise ValueError("at least one try is needed")


def stored(items: DataFrame, folder: str, fetch: Callable[[str], bytes], key: str = "id", url: str = "url", pause: float = 0.1, tries: int = 5) -> DataFrame:
    """Rows STORED for each item: where its bytes lie in the folder, their length and SHA-256, or why they couldn't be fetched.

    A file is named by the hash of the item's key, written beside its place and renamed, so it is whole or not there; an item whose file
    is there isn't fetched, so a run after a crash, or a task that is tried again, fetches only what is missing. Each task waits `pause`
    seconds between two requests and, when there are too many, as long as the service asks, `tries` times; then, and when access
    is refused, the job ends. The folder must be one that pyarrow's file systems read on every executor. Repeated keys are one item.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        files, home = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        files.create_dir(home, recursive=True)
        last = 0.0
        for frame in frames:
            rows = []
            for item, address in zip(frame[key], frame[url], strict=True):
                name = hashlib.sha256(str(item).encode()).hexdigest()
                place, error, content = f"{home.rstrip('/')}/{name}", None, None
                if files.get_file_info(place).type == fs.FileType.File:
                    with files.open_input_stream(place) as f:
                        content = f.read()
                else:
                    time.sleep(max(0.0, last + pause - time.monotonic()))
                    try:
                        content = _waiting(fetch, address, tries, pause)
                        beside = f"{place}.{uuid.uuid4().hex}.part"
                        with files.open_output_stream(beside) as f:
                            f.write(content)
                        files.move(beside, place)
                    except DownloadError as e:
                        error = str(e)
                    last = time.monotonic()
                rows.append((str(item), f"{folder.rstrip('/')}/{name}", len(content) if content is not None else None, hashlib.sha256(content).hexdigest() if content is not None else None, error))
            yield pd.DataFrame(rows, columns=["id", "path", "length", "sha256", "error"]).astype({"length": "Int64"})

    once = items.groupBy(key).agg(F.min(url).alias(url))
    done = once.mapInPandas(run, STORED)
    return done.withColumn("path", plain_path(F.col("path")))


def plain_path(path: Column) -> Column:
    """A local path as file scans write it (file:/...); others stay."""
    return F.when(path.startswith("/"), F.concat(F.lit("file:"), path)).otherwise(F.regexp_replace(path, "^file:/+", "file:/"))


def stored_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of whole stored files."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    found = spark.read.format("binaryFile").schema(schema).load(folder)
    return found.filter(~F.col("path").endswith(".part")).select(plain_path(F.col("path")).alias("path"), "content")


def original_urls(paths: DataFrame, stored: DataFrame) -> DataFrame:
    """Each asked path with the address of its photo in the service (productUrl); null for a path that isn't stored. stored: (path, productUrl)."""
    return paths.join(stored.select("path", F.col("productUrl").alias("original_url")).dropDuplicates(["path"]), "path", "left")


def cleaned(spark: SparkSession, folder: str, paths: list[str] | None = None) -> int:
    """Deletes the files of a cache folder (or those of the paths that lie in it) and gives their number. Paths are compared as
    the file system names them, with `..` resolved, so nothing outside the folder is touched however it is written. What is
    already gone is no error, so it can be called again and again."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(folder)
    files = root.getFileSystem(conf)
    if not files.exists(root):
        return 0

    def plain(path) -> str:
        whole = path.makeQualified(files.getUri(), files.getWorkingDirectory()).toUri().normalize()
        steps: list[str] = []
        for step in whole.getPath().split("/"):
            if step == "..":
                steps = steps[:-1]
            elif step not in ("", "."):
                steps.append(step)
        return f"{whole.getScheme()}://{whole.getAuthority() or ''}/{'/'.join(steps)}"

    home = plain(root)
    if paths is None:
        mine = [x.getPath() for x in files.listStatus(root)]
    else:
        named = [plain(jvm.org.apache.hadoop.fs.Path(p)) for p in dict.fromkeys(paths)]
        mine = [jvm.org.apache.hadoop.fs.Path(p) for p in dict.fromkeys(named) if p.startswith(f"{home}/")]
    return sum(bool(files.delete(p, True)) for p in mine)


def source(spark: SparkSession, kind: str, listing: type[MediaListing] | None = None, **options: str) -> DataFrame:
    """A library by kind: `local` (path), `saved_listing` (path, start, end), or `listing` (a subclass of MediaListing and its options)."""
    if kind == "local":
        from .library import scan_files

        return scan_files(spark, [options["path"]])
    if kind == "saved_listing":
        return saved_listing(spark, options["path"], options.get("start"), options.get("end"))
    if kind == "listing" and listing is not None:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # lets bounds on the day narrow the listing
        spark.dataSource.register(listing)
        return spark.read.format(listing.name()).options(**options).load()
    raise ValueError(f"unknown kind of source: {kind}")
