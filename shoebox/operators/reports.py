"""Reports over batches of work: results, chunks, sessions, progress."""

from __future__ import annotations

import resource
import sys
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordering import running_totals


def batch_result(log: DataFrame, failed: Column, by: list[str]) -> DataFrame:
    """Photos, failures and the success rate in percent, 0 for an empty batch."""
    out = log.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(failed).alias("failed"))
    out = out.withColumn("successful", F.col("total") - F.col("failed"))
    return out.withColumn("success_rate", F.when(F.col("total") == 0, 0.0).otherwise(100.0 * F.col("successful") / F.col("total")))


def numbered(log: DataFrame, bucket: Column, order: list[str], name: str = "ordinal") -> DataFrame:
    """Rows numbered from 1 in the order of (bucket, order)."""
    return running_totals(log, bucket, order, {name: F.lit(1)})


def chunked(log: DataFrame, failed: Column, bucket: Column, order: list[str], size: int) -> DataFrame:
    """The batch result of each chunk of `size` rows in order."""
    return batch_result(numbered(log, bucket, order).withColumn("chunk", F.floor((F.col("ordinal") - 1) / size)), failed, ["chunk"])


def progress(log: DataFrame, failed: Column, bucket: Column, order: list[str]) -> DataFrame:
    """Each row with how many were done and how many had failed by then."""
    return running_totals(log, bucket, order, {"done": F.lit(1), "failures": failed.cast("long")})


def tier_report(photos: DataFrame, by: list[str], tiers: tuple[str, ...] = ("high", "acceptable", "low"), tier: str = "tier", month: str = "month") -> DataFrame:
    """Photos, photos of each tier (a column each), and months that occur; undated photos count in no month."""
    return photos.groupBy(*by).agg(F.count("*").alias("total"), *(F.count_if(F.col(tier) == t).alias(t) for t in tiers), F.count_distinct(month).alias("months"))


def session_metrics(log: DataFrame, session: list[str], at: str = "ts", memory: str = "value") -> DataFrame:
    """Duration in seconds, photos, rate, and memory at start, peak and end."""
    seconds = (F.unix_micros(F.max(at).cast("timestamp")) - F.unix_micros(F.min(at).cast("timestamp"))) / 1e6
    first, last = F.min_by(memory, F.struct(at, "event_id")), F.max_by(memory, F.struct(at, "event_id"))
    out = log.groupBy(*session).agg(seconds.alias("duration"), F.count("*").alias("photos_processed"), first.alias("memory_start"), F.max(memory).alias("memory_peak_mb"), last.alias("memory_end"))
    return out.withColumn("memory_delta_mb", F.col("memory_end") - F.col("memory_start")).withColumn("photos_per_second", F.when(F.col("duration") > 0, F.col("photos_processed") / F.col("duration")).otherwise(0.0))


def session_summary(sessions: DataFrame, by: list[str]) -> DataFrame:
    """Sums over sessions; the rate is the ratio of the sums, not a mean of rates."""
    out = sessions.groupBy(*by).agg(F.count("*").alias("num_sessions"), F.sum("duration").alias("total_duration"), F.sum("photos_processed").alias("total_photos"), F.max("memory_peak_mb").alias("peak_memory_mb"), F.sum("memory_delta_mb").alias("total_memory_delta_mb"))
    return out.withColumn("avg_photos_per_second", F.when(F.col("total_duration") > 0, F.col("total_photos") / F.col("total_duration")).otherwise(0.0))


#: Bytes of what the system calls a unit of resident memory.
_UNIT = 1 if sys.platform == "darwin" else 1024


def watched(batch: DataFrame, failed: Column, name: str = "session") -> tuple[DataFrame, Observation]:
    """The rows of a batch as they are, and what their own job tells of it once it has run (session_of): rows and failures are counted where they are
    made, so nothing runs a second time. A row is stamped as its Arrow batch passes, with the time and the memory that its Python worker has taken so far.
    The rows of a task that is tried again count once: Spark keeps the observation of the attempt that succeeded."""
    stamps = ("_at", "_memory")
    if clash := set(stamps) & set(batch.columns):
        raise ValueError(f"columns already there: {', '.join(sorted(clash))}")
    columns = list(batch.columns)

    def stamped(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            now, memory = time.time(), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * _UNIT / 1e6
            full = [pa.array([x] * part.num_rows, pa.float64()) for x in (now, memory)]
            yield pa.RecordBatch.from_arrays([*part.columns, *full], [*part.schema.names, *stamps])

    schema = T.StructType([*batch.schema.fields, *(T.StructField(stamp, T.DoubleType()) for stamp in stamps)])
    seen = Observation(name)
    marks = batch.mapInArrow(stamped, schema).observe(
        seen, F.count(F.lit(1)).alias("photos_processed"), F.count_if(failed).alias("failed"), F.min("_at").alias("started"), F.max("_at").alias("ended"),
        F.min("_memory").alias("memory_least_mb"), F.max("_memory").alias("memory_peak_mb"),
    )
    return marks.select(*columns), seen


def session_of(seen: Observation) -> dict:
    """The session of a batch whose job has run, under the names of session_metrics; memory is that of the Python workers, from the least to the most
    that one of them had taken. An empty batch has zeros and no memory."""
    found = seen.get
    duration = (found["ended"] or 0.0) - (found["started"] or 0.0)
    least, most, rows = found["memory_least_mb"], found["memory_peak_mb"], found["photos_processed"]
    return {
        "duration": duration, "photos_processed": rows, "failed": found["failed"], "successful": rows - found["failed"], "success_rate": 100.0 * (rows - found["failed"]) / rows if rows else 0.0,
        "photos_per_second": rows / duration if duration > 0 else 0.0, "memory_peak_mb": most, "memory_delta_mb": None if most is None else most - least,
    }
