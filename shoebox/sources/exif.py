"""The date fields of EXIF blocks, read from files in Arrow batches: JPEG, TIFF, and PNG with an eXIf chunk."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

# Fixed values of the format: tag numbers.
ORIGINAL, PLAIN, DIGITIZED, SUB_BLOCK = 36867, 306, 36868, 34665


def exif_block(content: bytes) -> bytes | None:
    """The TIFF structure that holds the fields; None if the file has none."""
    if content[:4] in (b"II*\0", b"MM\0*"):
        return content
    if content[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(content) and content[at] == 0xFF:
            kind, size = content[at + 1], struct.unpack(">H", content[at + 2 : at + 4])[0]
            if kind == 0xE1 and content[at + 4 : at + 10] == b"Exif\0\0":
                return content[at + 10 : at + 2 + size]
            if kind == 0xDA:  # the picture begins
                return None
            at += 2 + size
    if content[:8] == b"\x89PNG\r\n\x1a\n":
        at = 8
        while at + 8 <= len(content):
            size = struct.unpack(">I", content[at : at + 4])[0]
            if content[at + 4 : at + 8] == b"eXIf":
                return content[at + 8 : at + 8 + size]
            at += 12 + size
    return None


def date_fields(block: bytes) -> dict[int, str]:
    """The texts of the date tags in the first directory and in the sub-block it names."""
    order = {b"II": "<", b"MM": ">"}.get(block[:2])
    if order is None:
        raise ValueError("no byte order mark")
    unpack = lambda kind, at: struct.unpack_from(order + kind, block, at)
    found: dict[int, str] = {}
    waiting, seen = [unpack("I", 4)[0]], set()
    while waiting:
        at = waiting.pop()
        if at in seen:
            continue
        seen.add(at)
        for i in range(unpack("H", at)[0]):
            tag, kind, count, value = unpack("HHII", at + 2 + 12 * i)
            if tag == SUB_BLOCK:
                waiting.append(value)
            elif tag in (ORIGINAL, PLAIN, DIGITIZED) and kind == 2:
                start = at + 2 + 12 * i + 8 if count <= 4 else value
                if start + count > len(block):
                    raise ValueError("a text goes beyond the block")
                found.setdefault(tag, block[start : start + count].split(b"\0")[0].decode("ascii", "replace").strip())
    return found


def date_texts(content: bytes | None) -> tuple[str | None, str | None, str | None, str | None]:
    """(original, plain, digitized, error) of a file's bytes; a damaged block has the error's text and no dates."""
    try:
        block = exif_block(content) if content else None
        found = date_fields(block) if block else {}
        return found.get(ORIGINAL), found.get(PLAIN), found.get(DIGITIZED), None
    except (ValueError, struct.error) as e:
        return None, None, None, f"{type(e).__name__}: {e}"


def exif_texts(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """Rows (key, original, plain, digitized, exif_error) for each file: its EXIF date texts, null where it has none. A
    damaged block has the error's text and no dates; it doesn't end the scan. Null content has none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = pd.DataFrame([date_texts(x) for x in frame[content]], columns=["original", "plain", "digitized", "exif_error"])
            out.insert(0, key, frame[key].to_numpy())
            yield out

    return files.select(key, content).mapInPandas(run, f"{key} {files.schema[key].dataType.simpleString()}, original string, plain string, digitized string, exif_error string")
