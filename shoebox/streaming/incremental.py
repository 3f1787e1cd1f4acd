"""Incremental scans: the same rules over files as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoebox.config import ScanConfig
from shoebox.operators import cache
from shoebox.sources.library import scanned

FILE = "path string, modificationTime timestamp, length long, content binary"


def new_photos(spark: SparkSession, root: str, config: ScanConfig = ScanConfig()) -> DataFrame:
    """A stream of the photos that appear under a root, with their content hash."""
    files = spark.readStream.format("binaryFile").schema(FILE).option("recursiveFileLookup", "true").load(root)
    return scanned(files, config).filter("skip_reason is null").withColumn("photo_hash", cache.content_hash(F.col("content"))).drop("skip_reason")


def upsert_sink(read_cache: Callable[[], DataFrame], write_cache: Callable[[DataFrame, int], None], score: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: scores each batch's new hashes and writes the next version of the cache, named by the batch,
    so a batch that is run twice writes the same version."""

    def step(batch: DataFrame, number: int) -> None:
        known = read_cache()
        fresh = score(batch.join(known.select("photo_hash"), "photo_hash", "left_anti"))
        write_cache(cache.upserted(known, fresh), number)

    return step
