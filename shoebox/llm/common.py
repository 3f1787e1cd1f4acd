"""What the operators share: written tables in the shared folder, and Arrow text columns as bytes."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share. Where that is unset, a
    temporary folder serves a local session; on a cluster the call raises."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = base or f"{tempfile.gettempdir()}/shoebox-shared"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends here, and a lost executor loses nothing."""
    df.write.parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def removed(spark: SparkSession, folder: str) -> None:
    """Deletes a table of the shared folder that no later plan reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def usable(vector: str) -> Column:
    """Not null, no null or non-finite component, and not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0)


def dense(column: pa.Array) -> np.ndarray:
    """A matrix of a column of lists of equal length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def commonest_size(rows: DataFrame, vector: str) -> int:
    """The commonest length of the arrays, the smallest of several; 0 without rows."""
    found = rows.groupBy(F.size(vector).alias("size")).count().agg(F.max(F.struct("count", (-F.col("size")).alias("less"))).alias("top")).first()["top"]
    return -found["less"] if found else 0


def bounded_sample(rows: DataFrame, n: int, size: int, key: str = "id") -> pa.Table:
    """The size rows of n with the smallest hash of their key. A limit on the hash is set from n, so that the tasks together send little more than
    that, however many they are; should the hashes be so uneven that fewer pass, the sample is smaller."""
    share = min(1.0, 1.2 * size / max(n, 1) + 100 / max(n, 1))
    place = F.pmod(F.xxhash64(key), F.lit(1 << 31))
    return rows.filter(place < int(share * (1 << 31))).orderBy(place, key).limit(size).toArrow()


def digest_bucket(column, divisor: int):
    """crc32 of a number written as text, mod divisor."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor


def text_slices(batch: pa.RecordBatch, column: str, max_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Row slices of a batch with about max_bytes of text each (one row at least), so that numpy's
    temporary arrays stay small whatever the batch size."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(lengths, dtype=np.int64)
    at = 0
    while at < len(total):
        before = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, before + max_bytes, side="right")))
        yield batch.slice(at, end - at)
        at = end


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in one array, and len + 1 offsets into it; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def places(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run, one after the other."""
    return np.arange(int(lengths.sum())) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


def spans_of(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of maximal runs of True, cut at the text borders in offsets."""
    if not len(member):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = member.copy()
    first[1:] &= ~member[:-1]
    last = member.copy()
    last[:-1] &= ~member[1:]
    heads = offsets[:-1][offsets[:-1] < len(member)]
    tails = offsets[1:][offsets[1:] > 0] - 1
    first[heads] = member[heads]
    last[tails] = member[tails]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def byte_class(test) -> np.ndarray:
    """256 booleans: test(code) for each byte."""
    return np.array([bool(test(i)) for i in range(256)])


#: Words by the contracts of the licence and contamination operators, and by that of near duplicates.
ALNUM_WORD = byte_class(lambda i: i >= 128 or chr(i).isalnum())
SPACED_WORD = byte_class(lambda i: i != 32 and not 9 <= i <= 13)

_R = np.random.default_rng(20240229)
BYTE_KEYS = _R.integers(1, 2**63, 256, dtype=np.uint64)
STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, max_bytes: int = 1 << 17) -> np.ndarray:
    """A 64-bit hash of the bytes of each (non-empty) run: keyed bytes times powers of an odd number by place. About max_bytes
    bytes at once are in the temporary arrays; a run may go on in the next ones."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    until = np.cumsum(lengths)
    begins = until - lengths
    power = np.ones(int(lengths.max()), np.uint64)
    power[1:] = STEP
    np.multiply.accumulate(power, out=power)
    value = np.zeros(len(starts), np.uint64)
    for a in range(0, int(until[-1]), max_bytes):
        b = min(a + max_bytes, int(until[-1]))
        here = slice(int(np.searchsorted(until, a, side="right")), int(np.searchsorted(begins, b)))
        head = np.maximum(begins[here], a)
        count = np.minimum(until[here], b) - head
        place = np.arange(a, b) - np.repeat(begins[here], count)
        keyed = BYTE_KEYS[data[np.repeat(starts[here], count) + place]] * power[place]
        value[here] += np.add.reduceat(keyed, head - a)
    return mixed(value)


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
