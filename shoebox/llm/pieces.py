"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

A text gets a marker (written as a space here, and as U+2581 in the vocabulary) for each space and one in front.
As no piece has a marker after another character, the best segmentation of a text is that of its
segments (markers, then other characters), and each distinct segment of a batch is solved once. All
start positions walk the trie together, one byte at a time; the Viterbi recursion then runs over the
places of all segments together. What no piece covers is spelt in byte pieces; a literal U+2581 is,
too, so decoding gives back every text exactly.

The vocabulary is an installed public file, given by path, and never trained. A unigram model's own log scores
are used; a merge-ranked (BPE) model has only ranks, which become log scores by Zipf's law. The model's normaliser
is not applied: a text is encoded as it stands, so that decoding is exact. Where a model's normaliser would change
a text (fold characters, drop repeated spaces), normalise it before to get that model's own pieces.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import run_hashes, text_slices, utf8

MARKER = "▁"
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@dataclass
class Vocabulary:
    """base, check, value: the double array; value is a piece's number or -1. bytes_of[b]: the piece of byte b.
    flat and border: the bytes of each piece with spaces for markers. spelt: the log score of a byte piece."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    score: np.ndarray
    bytes_of: np.ndarray
    is_byte: np.ndarray
    flat: np.ndarray
    border: np.ndarray
    spelt: float

    @property
    def size(self) -> int:
        return len(self.score)


def double_array(keys: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The trie of the keys: state s goes by byte b to t = base[s] + b + 1 if check[t] == s. First fit."""
    children: dict[bytes, list[int]] = defaultdict(list)
    for key in keys:
        for n in range(len(key)):
            children[key[:n]].append(key[n])
    size = 4 * sum(map(len, children.values())) + 1024
    base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    taken = bytearray(size)
    taken[0] = 1
    state, waiting, free, high = {b"": 0}, [b""], 258, 258
    while waiting:
        prefix = waiting.pop()
        codes = sorted(set(children[prefix]))
        while taken[free]:
            free += 1
        at = max(1, (free if len(codes) == 1 else max(free, high - 2048)) - codes[0] - 1)  # wide states look near the end only
        while any(taken[at + c + 1] for c in codes):
            at += 1
        base[state[prefix]], high = at, max(high, at + codes[-1] + 1)
        for c in codes:
            t, key = at + c + 1, prefix + bytes([c])
            taken[t], check[t], value[t] = 1, state[prefix], keys.get(key, -1)
            if key in children:
                state[key] = t
                waiting.append(key)
    end = len(taken.rstrip(b"\0")) + 257
    return base[:end], check[:end], value[:end]


def load_vocabulary(path: str = DEFAULT_MODEL) -> Vocabulary:
    """Reads a SentencePiece model file on the driver; it has some ten thousand pieces, whatever the corpus."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.vocab_size()
    pieces = [model.id_to_piece(i) for i in range(size)]
    plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    if any(MARKER in pieces[i].lstrip(MARKER) for i in plain):
        raise ValueError("a piece has a marker after another character; texts can't be cut at markers")
    own = np.array([model.get_score(i) for i in range(size)])
    ranked = bool(np.all(own[plain] == np.round(own[plain])))
    score = own.copy()
    if ranked:
        score[plain] = -np.log(np.arange(len(plain)) + 2.7) - np.log(np.log(len(plain) + 2.7))
    spelt = float(score[plain].min()) - 10.0
    byte_piece, is_byte = np.full(256, -1, np.int32), np.zeros(size, bool)
    for i in range(size):
        if model.is_byte(i):
            byte_piece[int(pieces[i][3:5], 16)], is_byte[i] = i, True
    if (byte_piece < 0).any():
        raise ValueError("the vocabulary lacks byte pieces")
    ordinary = set(plain)
    raw = [bytes([int(pieces[i][3:5], 16)]) if is_byte[i] else pieces[i].replace(MARKER, " ").encode() if i in ordinary else b"" for i in range(size)]
    base, check, value = double_array({raw[i]: i for i in reversed(plain)})
    return Vocabulary(base, check, value, score, byte_piece, is_byte, np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]), spelt)


def _places(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run, one after the other."""
    return np.arange(int(lengths.sum())) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


def _safe_cuts(begin: np.ndarray, end: np.ndarray, border: np.ndarray, n: int) -> np.ndarray:
    """The borders, and with them all places that no piece goes across: the best pieces before and after such a place
    don't depend on each other, so a long segment without spaces (base64, say) falls into many short ones."""
    wide = end - begin > 1
    across = np.bincount(begin[wide] + 1, minlength=n + 1) - np.bincount(end[wide], minlength=n + 1)
    free = np.cumsum(across)[: n + 1] == 0
    free[border] = True
    return np.flatnonzero(free)


def best_pieces(vocabulary: Vocabulary, data: np.ndarray, border: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece numbers of non-empty segments, one after the other, and their borders. border cuts data into segments.
    Among equal scores the longest last piece wins."""
    v, n, whole = vocabulary, len(data), border
    lengths = np.diff(border)
    offset, stop = _places(np.zeros(len(lengths), np.int64), lengths).astype(np.int32), np.repeat(border[1:], lengths).astype(np.int32)
    every = np.arange(n, dtype=np.int32)
    froms, tos, whats = [every], [every + 1], [v.bytes_of[data]]
    at, state = every, np.zeros(n, np.int32)
    depth = 0
    while len(at):
        step = v.base[state] + data[at + depth] + 1
        good = v.check[np.minimum(step, len(v.check) - 1)] == state
        at, state = at[good], step[good]
        depth += 1
        piece = v.value[state]
        found = piece >= 0
        froms.append(at[found])
        tos.append(at[found] + np.int32(depth))
        whats.append(piece[found])
        more = at + depth < stop[at]
        at, state = at[more], state[more]
    begin, end, what = map(np.concatenate, (froms, tos, whats))
    border = _safe_cuts(begin, end, border, n)
    lengths = np.diff(border)
    offset = _places(np.zeros(len(lengths), np.int64), lengths).astype(np.int32)
    gain = np.where(v.is_byte[what], v.spelt, v.score[what])
    order = np.lexsort((begin, end, offset[end - 1]))
    begin, end, what, gain = begin[order], end[order], what[order], gain[order]
    steps = np.concatenate([[0], np.cumsum(np.bincount(offset[end - 1]))])
    back, came = np.zeros(n + 1, np.int32), np.zeros(n + 1, np.int64)
    total = np.zeros(n + 1)  # the score up to a place; a segment's first place counts as 0
    first = np.zeros(n + 1, bool)
    first[border[:-1]] = True
    for a, b in zip(steps[:-1], steps[1:], strict=True):
        e = end[a:b]
        value = np.where(first[begin[a:b]], 0.0, total[begin[a:b]]) + gain[a:b]
        head = np.flatnonzero(np.append(True, e[1:] != e[:-1]))
        top = np.maximum.reduceat(value, head)
        pick = np.flatnonzero(value == np.repeat(top, np.diff(np.append(head, b - a))))[::-1]  # the longest piece is written last
        back[e[pick]], came[e[pick]] = what[a + pick], begin[a + pick]
        total[e[head]] = top
    count, now, alive = np.zeros(len(lengths), np.int64), border[1:].copy(), np.flatnonzero(lengths > 0)
    trail = []
    while len(alive):
        trail.append((alive, back[now[alive]]))
        count[alive] += 1
        now[alive] = came[now[alive]]
        alive = alive[now[alive] > border[:-1][alive]]
    cut = np.concatenate([[0], np.cumsum(count)])
    out, write = np.zeros(int(cut[-1]), np.int32), cut[1:].copy()
    for who, piece in trail:
        write[who] -= 1
        out[write[who]] = piece
    return out, cut[np.searchsorted(border, whole)]


def encode_batch(vocabulary: Vocabulary, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Piece numbers of all texts, one after the other, and the borders of the texts."""
    value = pc.fill_null(column.cast(pa.large_string()), "")
    text = lambda x: pa.scalar(x, pa.large_string())
    data, offsets = utf8(pc.if_else(pc.equal(value, text("")), text(""), pc.binary_join_element_wise(text(" "), value, text(""))))
    space = data == 32
    head = np.zeros(len(data), bool)
    head[1:] = space[1:] & ~space[:-1]
    head[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(head)
    ends = np.append(starts[1:], len(data))
    if not len(starts):
        return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
    _, first, which = np.unique(run_hashes(data, starts, ends), return_index=True, return_inverse=True)
    a, size = starts[first], (ends - starts)[first]
    pieces, cut = best_pieces(vocabulary, data[_places(a, size)], np.concatenate([[0], np.cumsum(size)]))
    count = np.diff(cut)[which]
    return pieces[_places(cut[which], count)], np.concatenate([[0], np.cumsum(count)])[np.searchsorted(starts, offsets)]


def decode_batch(vocabulary: Vocabulary, ids: np.ndarray, border: np.ndarray) -> list[bytes]:
    """The bytes of each text: the pieces' bytes with spaces for markers, without the one in front."""
    ids = np.clip(ids, 0, vocabulary.size - 1)
    size = np.diff(vocabulary.border)[ids]
    raw = vocabulary.flat[_places(vocabulary.border[ids], size)].tobytes()
    at = np.concatenate([[0], np.cumsum(size)])[border]
    return [raw[a + (raw[a : a + 1] == b" ") : b] for a, b in zip(at[:-1], at[1:], strict=True)]


def encode_pieces(docs: DataFrame, text: str = "text", key: str = "doc_id", keep: tuple[str, ...] = (), model: str = DEFAULT_MODEL) -> DataFrame:
    """Rows (key, keep..., ids array<int>, n_bytes, exact) for each row: the pieces of the whole text, how many of
    them are byte pieces, and whether decoding gives back the text.

    Null and empty texts have no pieces. Among segmentations of equal score the one whose last piece is longest wins,
    and so on backwards. Repeated rows each give a row; a null key is kept; columns other than keep are left out; an
    empty table gives no rows. A text of any length is one text; what bounds the work on it is its longest stretch
    that pieces cover without a gap.
    """
    sent = docs.sparkSession.sparkContext.broadcast(load_vocabulary(model))
    fields = [docs.schema[c] for c in dict.fromkeys([key, *keep])]
    schema = T.StructType([*fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_bytes", T.LongType()), T.StructField("exact", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = sent.value
        for batch in batches:
            for part in text_slices(batch, text, 1 << 20):
                ids, border = encode_batch(vocabulary, part.column(text))
                back = decode_batch(vocabulary, ids, border)
                exact = [(x or "").encode() == y for x, y in zip(part.column(text).to_pylist(), back, strict=True)]
                spelt = np.diff(np.concatenate([[0], np.cumsum(vocabulary.is_byte[ids])])[border])
                lists = pa.ListArray.from_arrays(pa.array(border, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in fields), lists, pa.array(spelt, pa.int64()), pa.array(exact)], names=schema.names)

    return docs.select(*dict.fromkeys([key, *keep, text])).mapInArrow(run, schema)


def decode_pieces(rows: DataFrame, ids: str = "ids", key: str = "doc_id", model: str = DEFAULT_MODEL) -> DataFrame:
    """Rows (key, text): the texts that lists of piece numbers stand for; bytes that aren't UTF-8 become U+FFFD.
    A null list gives null; numbers outside the vocabulary count as its nearest piece."""
    sent = rows.sparkSession.sparkContext.broadcast(load_vocabulary(model))
    schema = T.StructType([rows.schema[key], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(ids)
            flat = pc.fill_null(lists.flatten(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            border = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
            texts = [None if null else x.decode("utf-8", "replace") for x, null in zip(decode_batch(sent.value, flat, border), lists.is_null().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(texts, pa.string())], names=schema.names)

    return rows.select(key, ids).mapInArrow(run, schema)
