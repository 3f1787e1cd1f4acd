"""Personal data: four patterns, and a conditional random field over word shapes for the rest.

The field is trained on the driver from the small labelled table in pii_seed (its size is fixed), sent
to the executors, and decoded by Viterbi over batches of lines. Names, street addresses, dates of
birth, social security and account numbers come from the field; e-mail, IP, card and phone numbers
come from their patterns, and the field has labels for them only to tell them from the others.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import crf, pii_seed
from .common import ASCII_LOWER, SPACED_WORD, byte_class, mixed, run_hashes, spans_of, text_slices, utf8

# The base patterns, in the order in which spans with equal starts are listed.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("name", "street", "birth", "ssn", "iban")
LABELS = ["O", "mail", "phone", "card", "ip", *MORE_KINDS]
BUCKETS = 1 << 15
_DIGITS = re.compile("[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

SHAPE = np.frombuffer(bytes(88 if 65 <= i <= 90 else 120 if 97 <= i <= 122 or i >= 128 else 100 if 48 <= i <= 57 else i for i in range(256)), np.uint8)


#: No name has more words than this, or one of these bytes.
NAME_WORDS, NO_NAME = 6, byte_class(lambda i: chr(i) in "0123456789@=_")
CLOSING = np.zeros(256, bool)
CLOSING[list(b".,;:!?)\"'")] = True


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of EMAIL. A match has one @, and begins with the run of local characters before it,
    so the search starts there instead of at every character."""
    done = 0
    at = text.find("@")
    while at >= 0:
        low = at
        while low > done and text[low - 1] in _LOCAL:
            low -= 1
        if low < at and (m := EMAIL.match(text, low)):
            yield m.span()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the four patterns; a match that fails its test is dropped without another try."""
    out = []
    if "@" in text:
        out += [(a, "email", b) for a, b in _emails(text)]
    if _DIGITS.search(text):
        out += [(m.start(), "ip", m.end()) for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
                out.append((m.start(), "card", m.end()))
        if "+" in text:
            out += [(m.start(), "phone", m.end()) for m in PHONE.finditer(text) if 9 <= len(_DIGITS.findall(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], BASE_KINDS.index(s[1])))


def shape_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> crf.Features:
    """Ten hashed features of each word: without a punctuation mark at its end the word, its shape whole, collapsed,
    at the first and last four bytes, its last three bytes, its length and its count of digits; that mark; and the word with it."""
    low, shape = np.frombuffer(ASCII_LOWER, np.uint8)[data], SHAPE[data]
    marked = CLOSING[data[ends - 1]] & (ends - starts > 1)
    own = run_hashes(low, starts, ends)
    mark, ends = np.where(marked, data[ends - 1], 0).astype(np.uint64), ends - marked
    lengths = ends - starts
    bytes_at = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
    row = np.repeat(np.arange(len(starts)), lengths)
    s = shape[bytes_at]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (row[1:] != row[:-1])
    short, counts = s[new], np.bincount(row[new], minlength=len(starts))
    short_ends = np.cumsum(counts)
    digits = np.bincount(row, s == 100, len(starts)).astype(np.int64)
    columns = [
        run_hashes(low, starts, ends), run_hashes(shape, starts, ends), run_hashes(short, short_ends - counts, short_ends),
        run_hashes(shape, starts, np.minimum(ends, starts + 4)), run_hashes(shape, np.maximum(starts, ends - 4), ends),
        run_hashes(low, np.maximum(starts, ends - 3), ends), np.minimum(lengths, 24).astype(np.uint64), np.minimum(digits, 20).astype(np.uint64), mark, own,
    ]
    ids = np.stack([mixed(c + np.uint64(i * 1_000_003)) % np.uint64(BUCKETS) for i, c in enumerate(columns)], axis=1).astype(np.int64)
    return [(ids.ravel(), np.arange(len(starts) + 1) * ids.shape[1])]


def _word_list_features(words: list[bytes]) -> crf.Features:
    ends = np.cumsum([len(w) for w in words])
    return shape_features(np.frombuffer(b"".join(words), np.uint8), ends - [len(w) for w in words], ends)


@lru_cache(maxsize=2)
def trained(rows: int = 6000) -> crf.Crf:
    sequences = [([w.encode() for w, _ in s], [y if y == "O" else y[2:] for _, y in s]) for s in pii_seed.table(rows)]
    return crf.train(LABELS, _word_list_features, sequences, BUCKETS, contexts=(-2, -1, 0, 1, 2), rounds=180, rate=0.1, decay=1e-5, batches=8)


def sequence_borders(data: np.ndarray, starts: np.ndarray, offsets: np.ndarray, longest: int) -> np.ndarray:
    """Borders of the lines of each text, as numbers of words; a line over longest words is cut."""
    if not len(starts):
        return np.zeros(1, np.int64)
    line = np.cumsum(data == 10)[starts] + np.searchsorted(offsets, starts, side="right")
    new = np.append(True, (line[1:] != line[:-1]) | (np.diff(np.searchsorted(offsets, starts, side="right")) > 0))
    begin = np.flatnonzero(new)
    since = np.arange(len(starts)) - np.repeat(begin, np.diff(np.append(begin, len(starts))))
    return np.append(np.flatnonzero(since % longest == 0), len(starts))


def windows(border: np.ndarray, longest: int, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines over longest words in windows of so many, each with overlap words more on both sides, as far as the line
    goes: the places of all windows, the borders between them, and whether a place is in its window's inner part."""
    lengths = np.diff(border)
    pieces = -(-lengths // longest)
    line = np.repeat(np.arange(len(lengths)), pieces)
    low = border[line] + longest * (np.arange(len(line)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    high = np.minimum(low + longest, border[line + 1])
    begin, end = np.maximum(low - overlap, border[line]), np.minimum(high + overlap, border[line + 1])
    cut = np.concatenate([[0], np.cumsum(end - begin)])
    places = np.arange(cut[-1]) + np.repeat(begin - cut[:-1], end - begin)
    inner = (places >= np.repeat(low, end - begin)) & (places < np.repeat(high, end - begin))
    return places, cut, inner


def decoded(scores: np.ndarray, transitions: np.ndarray, border: np.ndarray, longest: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """The label of each place of the lines in border, and its probability where the label is one of MORE_KINDS."""
    places, cut, inner = windows(border, longest, overlap)
    if len(places) > len(scores):
        scores = scores[places]
    best = crf.viterbi(scores, transitions, cut)
    label, own = np.zeros(border[-1], np.int64), np.zeros(border[-1])
    label[places[inner]] = best[inner]
    hit = np.unique(np.searchsorted(cut, np.flatnonzero(inner & (best >= LABELS.index(MORE_KINDS[0]))), side="right") - 1)
    if len(hit):
        at = np.concatenate([np.arange(cut[i], cut[i + 1]) for i in hit])
        chance = crf.marginals(scores[at], transitions, np.concatenate([[0], np.cumsum(np.diff(cut)[hit])]))
        mine = inner[at]
        own[places[at[mine]]] = chance[mine, best[at[mine]]]
    return label, own


def field_spans(model: crf.Crf, data: np.ndarray, offsets: np.ndarray, sure: float, longest: int, overlap: int = 32) -> Iterator[tuple[int, int, str, int]]:
    """(row, start, kind, end) in code points of runs of one label, all of whose words have a probability of
    at least sure by forward-backward. Neighbours and runs go through the whole line, whatever its windows."""
    starts, ends = spans_of(SPACED_WORD[data], offsets)
    if not len(starts):
        return
    keys, first, which = np.unique(run_hashes(data, starts, ends), return_index=True, return_inverse=True)
    parts = shape_features(data, starts[first], ends[first])
    border = sequence_borders(data, starts, offsets, len(starts))
    label, own = decoded(model.place_scores(parts, len(keys), which, border), model.transitions, border, longest, overlap)
    places = np.flatnonzero(label >= LABELS.index(MORE_KINDS[0]))
    if not len(places):
        return
    line = np.searchsorted(border, places, side="right")
    new = np.append(True, (np.diff(places) > 1) | (np.diff(label[places]) != 0) | (np.diff(line) > 0))
    point = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    for a, b in zip(places[new], places[np.append(new[1:], True)] + 1, strict=True):
        if own[a:b].min() >= sure:
            s, e = starts[a], ends[b - 1]
            if LABELS[label[a]] == "name" and (b - a > NAME_WORDS or NO_NAME[data[s:e]].any()):
                continue
            while e > s + 1 and CLOSING[data[e - 1]]:
                e -= 1
            while s < e - 1 and data[s] in b"(\"'":
                s += 1
            row = int(np.searchsorted(offsets, s, side="right")) - 1
            base = point[offsets[row]]
            yield row, int(point[s] - base), LABELS[label[a]], int(point[e] - base)


def find_personal_data(docs: DataFrame, text: str = "text", key: str = "doc_id", sure: float = 0.75, longest: int = 256, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (key, keep..., spans array<struct<kind, start, end>>) for each row: personal data in the whole
    text by start, then by kind in the order of BASE_KINDS and MORE_KINDS, in code points, end exclusive.

    A null or empty text has no spans. Repeated rows each give a row; a null key is kept; an empty table gives no
    rows. Columns other than keep are left out. The field's spans that overlap a base span are left out; base spans always stay.
    Lines over longest words are decoded in windows that overlap, so a span may lie anywhere in a line.
    """
    fields = [docs.schema[c] for c in dict.fromkeys([key, *keep])]
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    schema = T.StructType([*fields, T.StructField("spans", T.ArrayType(span))])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    sent = docs.sparkSession.sparkContext.broadcast(trained())
    kinds = {k: i for i, k in enumerate(BASE_KINDS + MORE_KINDS)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for part in text_slices(batch, text):
                spans = [base_spans(x) if x else [] for x in part.column(text).to_pylist()]
                data, offsets = utf8(part.column(text))
                for row, start, kind, end in field_spans(model, data, offsets, sure, longest):
                    if not any(s < end and start < e for s, k, e in spans[row] if k in BASE_KINDS):
                        spans[row].append((start, kind, end))
                rows = [[{"kind": k, "start": s, "end": e} for s, k, e in sorted(x, key=lambda y: (y[0], kinds[y[1]]))] for x in spans]
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in fields), pa.array(rows, arrow)], names=schema.names)

    return docs.select(*dict.fromkeys([key, *keep, text])).mapInArrow(run, schema)


def masked_text(text: str, spans: str) -> Column:
    """The text with <KIND> in the place of each span; of overlapping spans, the first is named and their union goes."""
    source, start = F.col(text), F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))

    def step(state: Column, span: Column) -> Column:
        ahead = F.substring(source, state["at"] + 1, F.greatest(span["start"] - state["at"], F.lit(0)))
        mark = F.when(span["start"] >= state["at"], F.concat(ahead, F.lit("<"), F.upper(span["kind"]), F.lit(">"))).otherwise("")
        return F.struct(F.concat(state["done"], mark).alias("done"), F.greatest(state["at"], span["end"]).alias("at"))

    whole = F.aggregate(spans, start, step, lambda s: F.concat(s["done"], F.substring(source, s["at"] + 1, F.length(source))))
    return F.when(source.isNull() | (F.size(spans) == 0), source).otherwise(whole)
