"""WARC archives: written by Spark's text writer, read back by a verified chain of record borders.

Reading: the text reader splits the files at the record magic, wherever it stands; each task turns a
fragment into a candidate record and the offset of its successor (from the length in its header), and
offsets inside a split become offsets in the file by sums over its earlier splits. The magic can also
stand inside a payload. Pointer jumping from the start of each file keeps the candidates that the chain
of successors reaches, in a number of rounds that is the logarithm of the file's records; all
others are payload. Only numbers are grouped by file. Records whose payload holds the magic are put
together again from their fragments.

Versions 1.0 and 1.1 are read. Archives whose names end in .gz are read too, one or many members alike: the
reader unpacks them as one stream, so offsets are those of the unpacked file, and such a file is one split.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from .common import shared_dir, written

# Fixed values of the format.
VERSION, MAGIC, END = "WARC/1.1", "WARC/1.", "\r\n\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: eight groups of five hex digits give four letters each."""
    digest, letters = F.sha1(payload), []
    for g in range(8):
        value = F.conv(F.substring(digest, 5 * g + 1, 5), 16, 10).cast("int")
        letters += [F.lit(BASE32).substr(F.shiftright(value, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def write_warc(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """One record for each row into archives under path, payload in UTF-8 (null: empty).

    Of records with equal payloads of at least min_bytes bytes, that with the largest key is a response
    and the others are revisits that refer to it; smaller payloads are all responses. A repeated row
    repeats its record. Extra columns are left out; an empty table writes no record.
    """
    folder = shared_dir(pages.sparkSession)
    body = F.coalesce(payload, F.lit(""))
    rows = pages.select(F.col(key).cast("long").alias("page"), F.regexp_replace(F.coalesce(url, F.lit("")), r"[\r\n]+", "%0A").alias("url"), body.alias("body"))
    hashed = rows.withColumn("digest", base32_sha1(F.col("body").cast("binary"))).withColumn("bytes", F.octet_length("body").cast("long"))
    narrow = written(hashed.filter(F.col("bytes") >= min_bytes).select("page", "digest"), folder, "digests")
    firsts = written(narrow.groupBy("digest").agg(F.max("page").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"), folder, "responses")
    again = written(narrow.join(firsts, "digest").filter("page < first").distinct(), folder, "revisits")
    marked = hashed.join(again, ["page", "digest"], "left")  # few revisits are broadcast by their measured size, so payloads stay in place
    revisit = F.col("first").isNotNull()
    uri = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    block = F.when(revisit, F.lit(HTTP)).otherwise(F.concat(F.lit(HTTP), F.col("body")))
    header = F.concat_ws(
        "\r\n", F.lit(VERSION), F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")), F.concat(F.lit("WARC-Record-ID: "), uri("page")), F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")), F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")), F.concat(F.lit("X-Payload-Length: "), F.col("bytes").cast("string")),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {REVISIT}\r\nWARC-Refers-To: "), uri("first"))),
        F.lit("Content-Type: application/http; msgtype=response"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    marked.select(F.concat(header, F.lit(END), block).alias("value")).write.option("lineSep", END).text(path)


_HEAD = [("head", pa.int64()), ("length", pa.int64()), ("kind", pa.string()), ("page", pa.int64()), ("refers", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("declared", pa.int64()), ("id", pa.string()), ("refers_id", pa.string())]
_READ = [("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("whole", pa.bool_())]


def _number(text: str | None) -> int | None:
    text = (text or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text.isascii() and text.removeprefix("-").isdigit() else None


def parse_record(fragment: bytes) -> tuple:
    """The columns _HEAD and _READ of the bytes after a magic; head is null where no header with a length
    begins (after a version 0 or 1), whole is false where the bytes end before the record does."""
    cut = fragment.find(END.encode())
    if fragment[:3] not in (b"0\r\n", b"1\r\n"):
        cut = -1
    fields = {}
    for line in fragment[: max(cut, 0)].split(b"\r\n"):
        name, _, value = line.partition(b":")
        fields.setdefault(name.strip().lower(), value.strip().decode("utf-8", "replace"))
    length = _number(fields.get(b"content-length"))
    if cut < 0 or length is None or length < 0:
        return (None,) * 12 + (False,)
    block = fragment[cut + 4 : cut + 4 + length]
    at = block.find(END.encode()) if fields.get(b"content-type", "").lower().startswith("application/http") else -1
    payload = block[at + 4 :] if at >= 0 else block
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    kind = fields.get(b"warc-type")
    declared = fields.get(b"warc-payload-digest", "").removeprefix("sha1:")
    head = (len(MAGIC) + cut + 4, length, kind, _number(fields.get(b"warc-record-id")), _number(fields.get(b"warc-refers-to")), fields.get(b"warc-target-uri"), declared, _number(fields.get(b"x-payload-length")), fields.get(b"warc-record-id"), fields.get(b"warc-refers-to"))
    return *head, len(payload), digest, len(fragment) >= cut + 4 + length


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    meta = F.col("_metadata")
    return spark.read.option("lineSep", MAGIC).text(path).select(F.col("value").cast("binary").alias("value"), meta["file_path"].alias("file"), meta["file_block_start"].alias("split"))


def _numbered(fragments: DataFrame, parse: bool) -> DataFrame:
    """Each fragment with its offset in its split; parsed, or with its bytes."""
    columns = [("file", pa.string()), ("split", pa.int64()), ("place", pa.int64()), ("size", pa.int64()), *([*_HEAD, *_READ] if parse else [("value", pa.binary())])]
    schema = pa.schema(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, place = None, 0
        for batch in batches:
            rows = []
            for value, file, split in zip(*(batch.column(c).to_pylist() for c in ("value", "file", "split")), strict=True):
                if (file, split) != here:
                    here, place = (file, split), 0
                rows.append((file, split, place, len(value), *(parse_record(value) if parse else (value,))))
                place += len(value) + len(MAGIC)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), columns, strict=True)] if rows else [pa.array([], t) for _, t in columns], schema=schema)

    kinds = {pa.string(): T.StringType(), pa.int64(): T.LongType(), pa.bool_(): T.BooleanType(), pa.binary(): T.BinaryType()}
    return fragments.mapInArrow(run, T.StructType([T.StructField(n, kinds[t]) for n, t in columns]))


def _reached(candidates: DataFrame) -> DataFrame:
    """Rows (file, offset) that the chain from offset 0 reaches. Of a file, only pairs of numbers meet in a task."""

    def jump(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("offset")
        offset, after = frame["offset"].to_numpy(), frame["after"].to_numpy()
        n = len(offset)
        to = np.minimum(np.searchsorted(offset, after), n - 1)
        to = np.append(np.where(offset[to] == after, to, n), n)  # n: no candidate there, the chain ends
        reached = np.append(offset == 0, False)
        for _ in range(max(1, n).bit_length() + 1):
            reached[to[reached]] = True
            to = to[to]
        return frame[["file", "offset"]][reached[:n]]

    return candidates.groupBy("file").applyInPandas(jump, "file string, offset long")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Rows (page_id, url, record_type, refers_to, payload_bytes, payload_digest, stored_digest, intact,
    record_id, refers_to_id, file, offset): the records of the archives under path. The ids are texts as the header has them; page_id and refers_to are numbers where
    write_warc made them. Only a block of type application/http has a head before its payload; any other is all payload. Length and digest are taken from the stored
    payload of a response, and from the header of a revisit; intact says whether payload and header
    agree. Headers that a record lacks are null. A chain that breaks (a wrong length, a cut file) ends its file
    there: the records before it are returned. Folders without files, and empty files, give no rows; a file
    that has bytes but no record at its start raises ValueError."""
    folder = shared_dir(spark)
    parts = written(_numbered(_fragments(spark, path), True), folder, "fragments")
    splits = parts.groupBy("file", "split").agg(F.sum(F.col("size") + len(MAGIC)).alias("bytes"))
    before = F.coalesce(F.sum("bytes").over(W.Window.partitionBy("file").orderBy("split").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    splits = written(splits.select("file", "split", before.alias("base")), folder, "splits")
    placed = written(parts.join(splits, ["file", "split"]).withColumn("offset", F.col("base") + F.col("place") - len(MAGIC)), folder, "placed")
    begun = placed.groupBy("file").agg(F.max(F.col("head").isNotNull() & (F.col("offset") == 0)).alias("good"), F.max("size").alias("size"))
    if wrong := begun.filter("not good and size > 0").limit(3).collect():
        raise ValueError(f"no record at the start of {', '.join(r['file'] for r in wrong)}")
    candidates = placed.filter("offset >= 0 and head is not null").select("file", "offset", (F.col("offset") + F.col("head") + F.col("length") + len(END)).alias("after"))
    chain = written(_reached(candidates), folder, "chain")
    records = placed.join(chain, ["file", "offset"], "left_semi")
    cut = records.filter("not whole").select("file", F.col("offset").alias("owner"), (F.col("offset") + F.col("head") + F.col("length")).alias("until"))
    cut = written(cut, folder, "cut")
    if cut.limit(1).count():
        records = records.filter("whole").unionByName(_rejoined(spark, path, placed, cut, splits), allowMissingColumns=True)
    response = F.col("kind") != "revisit"
    return records.select(
        F.col("page").alias("page_id"), "url", F.col("kind").alias("record_type"), F.col("refers").alias("refers_to"),
        F.when(response, F.col("payload_bytes")).otherwise(F.col("declared")).alias("payload_bytes"), F.when(response, F.col("payload_digest")).otherwise(F.col("digest")).alias("payload_digest"),
        F.col("digest").alias("stored_digest"), (~response | (F.col("payload_digest") == F.col("digest"))).alias("intact"), F.col("id").alias("record_id"), F.col("refers_id").alias("refers_to_id"), "file", "offset",
    )


def _rejoined(spark: SparkSession, path: str, placed: DataFrame, cut: DataFrame, splits: DataFrame) -> DataFrame:
    """The records whose payload holds the magic. Only the fragments they cover are read again and moved."""
    owner = F.last("owner", ignorenulls=True).over(W.Window.partitionBy("file").orderBy("offset"))
    until = F.last("until", ignorenulls=True).over(W.Window.partitionBy("file").orderBy("offset"))
    starts = placed.filter("offset >= 0").select("file", "split", "place", "offset").join(cut.withColumn("offset", F.col("owner")), ["file", "offset"], "left")
    covered = starts.select("file", "split", "place", "offset", owner.alias("owner"), until.alias("until")).filter("offset < until")
    values = _numbered(_fragments(spark, path), False).join(covered, ["file", "split", "place"])
    joined = values.groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("offset", "value"))).alias("pieces"))
    schema = T.StructType([T.StructField("file", T.StringType()), T.StructField("offset", T.LongType()), *(T.StructField(n, {pa.string(): T.StringType(), pa.int64(): T.LongType(), pa.bool_(): T.BooleanType()}[t]) for n, t in [*_HEAD, *_READ])])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(r["file"], r["owner"], *parse_record(MAGIC.encode().join(p["value"] for p in r["pieces"]))) for r in batch.to_pylist()]
            types = [pa.string(), pa.int64(), *(t for _, t in [*_HEAD, *_READ])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(types), types, strict=True)], names=schema.names)

    return joined.mapInArrow(parse, schema)
