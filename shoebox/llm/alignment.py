"""Alignment of two tokenizers over the same bytes: groups that both end together, overlaps, and how common each overlap is.

Both tokenizers cut the same bytes (a space and the text). Where tokens of both end at one byte, a group closes; an A and
a B token are linked where their bytes overlap. Between two neighbouring ends (of either tokenizer) lies exactly one
link, so links are counted by merging the two lists of ends.

1. Texts are dealt to blocks of bounded size, in the order in which they are read. A text over part_bytes goes to
   parts: each tokenizer's input is cut where that tokenizer never joins what lies on both sides, so the two are cut at different
   bytes, and parts are encoded by different tasks.
2. A part is a fragment: an open prefix up to its first common end, closed groups, and an open suffix after the last.
   Fragments compose: the suffix of one and the prefix of the next close to a run of groups; a part without a common
   end is all prefix. Composition is associative, so the fragments of a text are reduced in rounds, a few neighbours in each group,
   over all tasks; what closes on the way stands beside the parts' own closed groups.
3. Each block tells which id pairs its texts link and in how many texts; summed over the corpus, these are the counts. Each block
   then fetches the counts of its own pairs and is encoded once more, so neither texts' links nor tokens are ever stored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_class, places, removed, run_hashes, shared_dir, text_slices, utf8, written
from .neardup import grows
from .pieces import DEFAULT_MODEL, MARKER

BYTE_MODEL = "/opt/tokenizers/byte_bpe_50k.json"
#: The pattern by which byte-level BPE of this kind cuts a text into words before merging.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Places at which A, and B, never join the bytes on both sides: a word of A never has white space after another character;
#: no piece of B has its marker after another character.
CUT_A = re.compile(rb"(?<=[A-Za-z0-9])[ \n\t\r]")
CUT_B = re.compile(rb"(?<=[^ ]) (?=[^ ])")
CUT_AFTER = byte_class(lambda i: 32 < i < 127)
SHIFT = 20
REMEMBERED = 200_000  # strings whose ids a worker keeps


@dataclass(frozen=True)
class Alignment:
    """byte_model, piece_model: files of tokenizers A and B, read on the driver. part_bytes: a longer text is split. block_bytes:
    about so much text meets its counts at once. fan: fragments composed in a group of a round."""

    byte_model: str = BYTE_MODEL
    piece_model: str = DEFAULT_MODEL
    part_bytes: int = 1 << 18
    block_bytes: int = 8 << 20
    fan: int = 16


@lru_cache(maxsize=2)
def tokenizers(byte_model: str, piece_model: bytes) -> Tokenizers:
    """One pair of tokenizers for each worker process."""
    return Tokenizers(byte_model, piece_model)


class Tokenizers:
    """A and B from the contents of their files, with the bytes of all tokens one behind the other."""

    def __init__(self, byte_model: str, piece_model: bytes):
        import sentencepiece
        import tiktoken

        known = json.loads(byte_model)
        special = {t["content"] for t in known["added_tokens"]}
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in printed} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printed)}
        ranks = {bytes(letters[c] for c in token): number for token, number in known["model"]["vocab"].items() if token not in special}
        self.a = tiktoken.Encoding("a", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        size = max(ranks.values()) + 1
        self.size_a, self.size_b = size, self.b.vocab_size()
        raw_a = [b""] * size
        for token, number in ranks.items():
            raw_a[number] = token
        pieces = [self.b.id_to_piece(i) for i in range(self.size_b)]
        raw_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARKER, " ").encode() for i, p in enumerate(pieces)]
        self.flat, self.border, self.size_of, self.recent = [], [], [], {}
        for raw in (raw_a, raw_b):
            self.flat.append(np.frombuffer(b"".join(raw), np.uint8))
            self.size_of.append(np.array([len(r) for r in raw]))
            self.border.append(np.concatenate([[0], np.cumsum(self.size_of[-1])]))
        names = [f"{i}{end}" for i in range(size) for end in ",|"] + [f"{i}{end}" for i in range(self.size_b) for end in ",;"]
        self.names = np.array(names, object)

    def encoded_a(self, text: str) -> np.ndarray:
        """text as it stands, a leading space and all."""
        return np.array(self.a.encode_ordinary(text), np.int32)

    def encoded_b(self, text: str) -> np.ndarray:
        """text without its leading space, which B adds itself."""
        return np.array(self.b.encode(text, num_threads=1), np.int32)

    def stretches(self, strings: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and B of each string (which starts with a space). Those of recent strings are remembered."""
        if len(self.recent) > REMEMBERED:
            self.recent.clear()
        new = [x for x in strings if x not in self.recent]
        for x, b in zip(new, self.b.encode([x[1:] for x in new], num_threads=1), strict=True):
            self.recent[x] = self.a.encode_ordinary(x), b
        found = [self.recent[x] for x in strings]
        return [a for a, _ in found], [b for _, b in found]

    def lengths(self, side: int, ids: np.ndarray) -> np.ndarray:
        return self.size_of[side][ids]

    def bytes_of(self, side: int, ids: np.ndarray) -> bytes:
        return self.flat[side][places(self.border[side][ids], self.lengths(side, ids))].tobytes()


@dataclass
class Fragment:
    """Open ends of a byte range: ids of A and B up to the first common end (closes) and after the last. Where the range has no common end
    (first is -1), all is prefix. first: the number of the part that has the first common end."""

    first: int = -1
    prefix: tuple[list[int], list[int]] = field(default_factory=lambda: ([], []))
    suffix: tuple[list[int], list[int]] = field(default_factory=lambda: ([], []))

    def then(self, other: Fragment) -> tuple[Fragment, tuple[int, list[int], list[int]] | None]:
        """The fragment of both ranges, and the groups that close between them: (part, ids of A, ids of B)."""
        join = lambda x, y: ([*x[0], *y[0]], [*x[1], *y[1]])
        if self.first < 0:
            return Fragment(other.first, join(self.prefix, other.prefix), other.suffix), None
        open_ = join(self.suffix, other.prefix)
        if other.first < 0:
            return Fragment(self.first, self.prefix, open_), None
        return Fragment(self.first, self.prefix, other.suffix), (other.first, *open_)


def fragment(part: int, a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[Fragment, np.ndarray, np.ndarray]:
    """A part's open ends, and its ids inside the closed middle. ends are bytes from the start of the text."""
    common = np.intersect1d(ends_a, ends_b, assume_unique=True)
    if not len(common):
        return Fragment(-1, (a.tolist(), b.tolist())), a[:0], b[:0]
    cut = [(np.searchsorted(e, common[0], side="right"), np.searchsorted(e, common[-1], side="right")) for e in (ends_a, ends_b)]
    (a0, a1), (b0, b1) = cut
    return Fragment(part, (a[:a0].tolist(), b[:b0].tolist()), (a[a1:].tolist(), b[b1:].tolist())), a[a0:a1], b[b0:b1]


def cuts(data: bytes, where: re.Pattern, step: int) -> list[int]:
    """0, the first allowed place from each multiple of step on, and the end."""
    found = [0]
    for k in range(1, -(-len(data) // step)):
        hit = where.search(data, k * step)
        found.append(max(found[-1], hit.start()) if hit else len(data))
    return [*found, len(data)]


@dataclass
class Lined:
    """The links and groups of several texts, each of which starts and ends at a common end. a, b: ids of all; at: the borders of the texts
    in links and groups; links are pairs of token numbers."""

    link_a: np.ndarray
    link_b: np.ndarray
    link_at: np.ndarray
    group_at: np.ndarray
    codes: np.ndarray


def lined_up(t: Tokenizers, a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, named: bool = True) -> Lined:
    ends_a, ends_b = np.cumsum(t.lengths(0, a)), np.cumsum(t.lengths(1, b))
    last_a, last_b = (np.zeros(int(ends_a[-1]) + 1 if len(a) else 1, bool) for _ in range(2))  # by byte: does a token end here?
    last_a[ends_a], last_b[ends_b] = True, True
    both, before = last_a & last_b, lambda mark: np.cumsum(mark, dtype=np.int32) - mark
    every, common = np.flatnonzero(last_a | last_b), np.flatnonzero(both)
    before_a, before_b = before(last_a), before(last_b)
    border = np.concatenate([[0], ends_a])[at_a]
    codes = np.zeros(0, np.int64)
    if named:
        closed = before(both)
        codes = np.zeros(len(a) + len(b), np.int64)
        through = [np.concatenate([[0], mark[common] + 1]) for mark in (before_a, before_b)]  # tokens up to each common end
        codes[np.arange(len(a)) + through[1][closed[ends_a]]] = 2 * a.astype(np.int64) + both[ends_a]
        codes[np.arange(len(b)) + through[0][1:][closed[ends_b]]] = 2 * (t.size_a + b.astype(np.int64)) + both[ends_b]
    return Lined(before_a[every], before_b[every], np.searchsorted(every, border, side="right"), np.searchsorted(common, border, side="right"), codes)


def encoded_texts(t: Tokenizers, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of A and B of all texts and their borders; a text whose tokens don't give back its bytes has none.

    Both tokenizers allow a cut before a single space that follows another visible ASCII character, so each distinct stretch between such cuts is encoded
    once. A text whose bytes don't come back is encoded once more as a whole, so that two stretches with one hash spoil nothing."""
    value = pc.fill_null(texts.cast(pa.large_string()), "")
    scalar = lambda x: pa.scalar(x, pa.large_string())
    data, offsets = utf8(pc.if_else(pc.equal(value, scalar("")), scalar(""), pc.binary_join_element_wise(scalar(" "), value, scalar(""))))
    n = len(offsets) - 1
    none = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    if not len(data):
        return none
    head, space = np.zeros(len(data), bool), data == 32
    head[1:-1] = space[1:-1] & CUT_AFTER[data[:-2]] & ~space[2:]
    head[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(head)
    ends = np.append(starts[1:], len(data))
    _, first, which = np.unique(run_hashes(data, starts, ends), return_index=True, return_inverse=True)
    raw, cut = data.tobytes(), np.searchsorted(starts, offsets)
    strings = [raw[x:y].decode() for x, y in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
    out = []
    for side, ids in enumerate(t.stretches(strings)):
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.int32, int(size.sum()))
        begin, many = (np.cumsum(size) - size)[which], size[which]
        at = np.concatenate([[0], np.cumsum(many)])[cut]
        flat = flat[places(begin, many)]
        byte_at = np.concatenate([[0], np.cumsum(t.lengths(side, flat))])[at]
        back = np.frombuffer(t.bytes_of(side, flat), np.uint8)
        same = np.diff(byte_at) == np.diff(offsets)
        if same.all():  # the places agree, so one comparison does for all
            wrong = np.flatnonzero(back != data)
            same[np.searchsorted(offsets, wrong, side="right") - 1] = False
        else:
            same &= np.array([np.array_equal(back[x:y], data[p:q]) for x, y, p, q in zip(byte_at[:-1], byte_at[1:], offsets[:-1], offsets[1:], strict=True)])
        out.append((flat, at, same))
    (a, at_a, good_a), (b, at_b, good_b) = out
    if (good_a & good_b).all():
        return a, b, at_a, at_b
    parts_a, parts_b = [], []
    for k, good in enumerate(good_a & good_b):
        one, two = a[at_a[k] : at_a[k + 1]], b[at_b[k] : at_b[k + 1]]
        if not good:
            whole = raw[offsets[k] : offsets[k + 1]]
            one, two = t.encoded_a(whole.decode()), t.encoded_b(whole[1:].decode())
            if t.bytes_of(0, one) != whole or t.bytes_of(1, two) != whole:
                one = two = none[0]
        parts_a.append(one)
        parts_b.append(two)
    return np.concatenate(parts_a), np.concatenate(parts_b), _border(parts_a), _border(parts_b)


def _border(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)]).astype(np.int64)


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a column of lists without nulls, and the borders of its rows."""
    count = column.value_lengths().to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(count)]).astype(np.int64)


def _tokens(t: Tokenizers, rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of rows that hold texts, or, where the text is null, ids."""
    texts = rows.column("text")
    a, b, at_a, at_b = encoded_texts(t, texts)
    if texts.null_count == 0:
        return a, b, at_a, at_b
    own_a, own_at_a = _ids(rows.column("a"))
    own_b, own_at_b = _ids(rows.column("b"))
    stored = texts.is_null().to_numpy(zero_copy_only=False)
    both = lambda x, at, y, own: [y[own[k] : own[k + 1]] if stored[k] else x[at[k] : at[k + 1]] for k in range(len(stored))]
    parts_a, parts_b = both(a, at_a, own_a, own_at_a), both(b, at_b, own_b, own_at_b)
    return np.concatenate(parts_a), np.concatenate(parts_b), _border(parts_a), _border(parts_b)


def _pairs(a: np.ndarray, b: np.ndarray, lined: Lined) -> np.ndarray:
    """One number for the id pair of each link."""
    return (a[lined.link_a].astype(np.int64) << SHIFT) | b[lined.link_b]


ITEM = "row long, doc long, part long, block long, text string, a array<int>, b array<int>"


def _dealt(texts: DataFrame, cfg: Alignment) -> DataFrame:
    """Rows ITEM of (row, doc, text): texts stay where they are read and are numbered by block; null becomes empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, filled, here = 0, 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in text_slices(batch, "text", 1 << 20):
                n, size = part.num_rows, part.column("text").nbytes
                if filled and filled + size > cfg.block_bytes:
                    block, filled = block + 1, 0
                filled += size
                none = pa.array([[]] * n, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc"), pa.array(np.zeros(n, np.int64)), pa.array(np.full(n, here + block)), part.column("text"), none, none], names=["row", "doc", "part", "block", "text", "a", "b"])

    return texts.mapInArrow(run, ITEM)


def _split(texts: DataFrame, cfg: Alignment) -> DataFrame:
    """Rows (row, doc, part, from_a, text_a, from_b, text_b) of long texts: what A, and B, encode of each part, and the bytes at which that starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, doc, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc", "text")), strict=True):
                data = (" " + text).encode()
                at_a, at_b = cuts(data, CUT_A, cfg.part_bytes), cuts(data, CUT_B, cfg.part_bytes)
                for k in range(len(at_a) - 1):
                    pieces = [pa.array([data[at[k] : at[k + 1]]], pa.binary()).cast(pa.string()) for at in (at_a, at_b)]
                    yield pa.RecordBatch.from_arrays([pa.array([row]), pa.array([doc], pa.int64()), pa.array([k]), pa.array([at_a[k]]), pieces[0], pa.array([at_b[k]]), pieces[1]], names=["row", "doc", "part", "from_a", "text_a", "from_b", "text_b"])

    return texts.mapInArrow(run, "row long, doc long, part long, from_a long, text_a string, from_b long, text_b string")


FRAGMENT = "row long, doc long, part long, good boolean, first long, prefix_a array<int>, prefix_b array<int>, suffix_a array<int>, suffix_b array<int>, a array<int>, b array<int>"


def _fragments(parts: DataFrame, loaded) -> DataFrame:
    """Rows FRAGMENT of split parts; a and b are the closed middle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, names = loaded(), [c.split()[0] for c in FRAGMENT.split(", ")]
        for batch in batches:
            for r in batch.to_pylist():
                a = t.encoded_a(r["text_a"]) if r["text_a"] else np.zeros(0, np.int32)
                b = t.encoded_b(r["text_b"][1:]) if r["text_b"] else np.zeros(0, np.int32)
                good = t.bytes_of(0, a) == r["text_a"].encode() and t.bytes_of(1, b) == r["text_b"].encode()
                f, mid_a, mid_b = fragment(r["part"], a, b, r["from_a"] + np.cumsum(t.lengths(0, a)), r["from_b"] + np.cumsum(t.lengths(1, b)))
                ids = [pa.array([x], pa.list_(pa.int32())) for x in (*f.prefix, *f.suffix, mid_a.tolist(), mid_b.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array([r["row"]]), pa.array([r["doc"]], pa.int64()), pa.array([r["part"]]), pa.array([good]), pa.array([f.first]), *ids], names=names)

    return parts.mapInArrow(run, FRAGMENT)


def _reduced(fragments: DataFrame, folder: str, cfg: Alignment) -> DataFrame:
    """Rows (row, doc, part, a, b): what closes between the fragments of each text, by rounds over groups of cfg.fan neighbours; what is open
    when one fragment is left closes at the start and the end of the text. Rows come as (closed false: still a fragment; true: closed, a and b are in the prefix)."""
    columns = ("row", "doc", "part", "first", "prefix_a", "prefix_b", "suffix_a", "suffix_b")
    schema = "row long, doc long, part long, first long, prefix_a array<int>, prefix_b array<int>, suffix_a array<int>, suffix_b array<int>, closed boolean"

    def fold(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        whole, out, head = Fragment(), [], rows[0]
        for r in rows:
            whole, groups = whole.then(Fragment(r["first"], (r["prefix_a"], r["prefix_b"]), (r["suffix_a"], r["suffix_b"])))
            if groups:
                out.append((head["row"], head["doc"], groups[0], groups[0], groups[1], groups[2], [], [], True))
        out.append((head["row"], head["doc"], head["part"] // cfg.fan, whole.first, *whole.prefix, *whole.suffix, False))
        types = [pa.int64()] * 4 + [pa.list_(pa.int32())] * 4 + [pa.bool_()]
        return pa.table([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[*columns, "closed"])

    now, closed, round_ = fragments.select(*columns), [], 0
    most = fragments.agg(F.max("part")).first()[0] or 0
    while True:
        step = written(now.groupBy("row", F.floor(F.col("part") / cfg.fan)).applyInArrow(fold, schema), folder, f"round-{round_}")
        closed.append(step.filter("closed"))
        now, most, round_ = step.filter("not closed").select(*columns), most // cfg.fan, round_ + 1
        if most == 0:
            break
    done = closed[0]
    for c in closed[1:]:
        done = done.unionByName(c)
    ends = (F.struct(F.greatest("first", F.lit(0).cast("long")).alias("part"), F.col("prefix_a").alias("a"), F.col("prefix_b").alias("b")), F.struct(F.lit(1 << 40).alias("part"), F.col("suffix_a").alias("a"), F.col("suffix_b").alias("b")))
    ends = now.select("row", "doc", F.explode(F.array(*ends)).alias("end")).select("row", "doc", "end.*").filter(F.size("a") + F.size("b") > 0)
    return done.select("row", "doc", "part", F.col("prefix_a").alias("a"), F.col("prefix_b").alias("b")).unionByName(ends)


def token_alignment(docs: DataFrame, text: str = "text", key: str = "doc_id", cfg: Alignment = Alignment()) -> DataFrame:
    """Rows (key as long, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one for each row.

    The count of an id pair is the number of rows in which it is linked; n_best are the links whose count is the highest of their A
    id; count_sum sums the counts of all links. Texts that are null or empty, or whose tokens don't give back the bytes, have no tokens: all numbers
    are 0 and groups_sha256 is ''. Repeated rows each count and each give a row; a null key is kept; other columns are left
    out; an empty table gives no rows. A long text is split where tokenizers allow it: a stretch without such a place
    (no white space after a letter or digit, say) stays in one part. One text's groups are hashed in order by one task, part by part.
    """
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession)
    with open(cfg.byte_model, encoding="utf-8") as f:
        byte_model = f.read()
    with open(cfg.piece_model, "rb") as f:
        piece_model = f.read()
    sent = spark.sparkContext.broadcast((byte_model, piece_model))  # two vocabulary files

    def loaded() -> Tokenizers:
        return tokenizers(*sent.value)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("doc"), F.coalesce(text, F.lit("")).alias("text"))
    is_long = F.octet_length("text") > cfg.part_bytes
    short = written(_dealt(rows.filter(~is_long), cfg), folder, "short")
    long_rows = rows.filter(is_long)  # row numbers of both kinds are taken before the filter, in the same plan
    parts = _split(long_rows, cfg).repartition("row", "part")
    fragments = written(_fragments(parts, loaded), folder, "fragments")
    bad = written(fragments.filter("not good").select("row").distinct(), folder, "bad")
    middles = fragments.filter("first >= 0").select("row", "doc", (2 * F.col("part") + 1).alias("part"), "a", "b")
    between = _reduced(fragments, folder, cfg).withColumn("part", 2 * F.col("part"))
    longs = between.unionByName(middles).join(grows(bad), "row", "left_anti")
    longs = written(longs.select("row", "doc", "part", F.xxhash64("row", F.floor(F.col("part") / 16)).alias("block"), F.lit(None).cast("string").alias("text"), "a", "b"), folder, "longs")

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(block, row, pair, n): the pairs of each block and in how many texts; of long texts, row by row."""
        t, here, kept = loaded(), None, []

        def flush() -> pa.RecordBatch:
            pair = np.concatenate([p for p, _ in kept])
            known, which = np.unique(pair, return_inverse=True)
            n = np.bincount(which, np.concatenate([c for _, c in kept])).astype(np.int64)
            block, row = here
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(known), block)), pa.array([row] * len(known), pa.int64()), pa.array(known), pa.array(n)], names=["block", "row", "pair", "n"])

        for batch in batches:
            blocks, row, is_text = batch.column("block").to_numpy(), batch.column("row").to_numpy(), ~batch.column("text").is_null().to_numpy(zero_copy_only=False)
            mark = np.where(is_text, -1, row)
            change = np.flatnonzero((blocks[1:] != blocks[:-1]) | (mark[1:] != mark[:-1])) + 1
            for low, high in zip([0, *change], [*change, len(blocks)], strict=True) if len(blocks) else ():
                now = (int(blocks[low]), None if is_text[low] else int(row[low]))
                if now != here:
                    if kept:
                        yield flush()
                    here, kept = now, []
                for part in text_slices(batch.slice(low, high - low), "text", 1 << 20):
                    a, b, at_a, at_b = _tokens(t, part)
                    lined = lined_up(t, a, b, at_a, at_b, named=False)
                    text_no = np.repeat(np.arange(part.num_rows), np.diff(lined.link_at))
                    pair = np.unique((text_no.astype(np.int64) << 2 * SHIFT) | _pairs(a, b, lined)) & ((1 << 2 * SHIFT) - 1)
                    if len(pair):
                        kept.append(np.unique(pair, return_counts=True))
        if kept:
            yield flush()

    items = short.unionByName(longs)
    told_pairs = written(items.mapInArrow(told, "block long, row long, pair long, n long"), folder, "pairs")
    of_long = told_pairs.filter("row is not null").select("row", "pair").distinct().select("pair", F.lit(1).cast("long").alias("n"))
    counts = told_pairs.filter("row is null").select("pair", "n").unionByName(of_long).groupBy("pair").agg(F.sum("n").alias("count"))
    counts = written(counts.withColumn("id", F.shiftright("pair", SHIFT)), folder, "counts")
    top = F.broadcast(counts.groupBy("id").agg(F.max("count").alias("top")))  # a row for each id of A at most
    judged = counts.join(top, "id").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))
    fetched = told_pairs.select("block", "pair").join(grows(judged), "pair")

    def summed(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        t, out = loaded(), []
        pair, first = np.unique(theirs["pair"].to_numpy(), return_index=True)
        count, best = theirs["count"].to_numpy()[first], theirs["best"].to_numpy()[first]
        for batch in mine.combine_chunks().to_batches():
            for part in text_slices(batch, "text", 1 << 20):
                a, b, at_a, at_b = _tokens(t, part)
                lined = lined_up(t, a, b, at_a, at_b)
                place = np.searchsorted(pair, _pairs(a, b, lined))
                total = lambda x, at=lined.link_at, place=place: np.diff(np.concatenate([[0], np.cumsum(x[place] if len(place) else place, dtype=np.int64)])[at])
                names, is_text, texts = t.names[lined.codes], ~part.column("text").is_null().to_numpy(zero_copy_only=False), []
                for k, (lo, hi) in enumerate(zip(at_a[:-1] + at_b[:-1], at_a[1:] + at_b[1:], strict=True)):
                    joined = "".join(names[lo:hi].tolist())[:-1]
                    texts.append(sha256(joined.encode()).hexdigest() if is_text[k] and joined else joined)
                numbers = (np.diff(at_a), np.diff(at_b), np.diff(lined.group_at), np.diff(lined.link_at), total(best), total(count))
                out.append(pa.table([*(part.column(c) for c in ("row", "doc", "part")), pa.array(~is_text), *(pa.array(x.astype(np.int64)) for x in numbers), pa.array(texts, pa.string())], names=[c.split()[0] for c in RESULT.split(", ")]))
        return pa.concat_tables(out) if out else pa.Table.from_pylist([], pa.schema([(c.split()[0], {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}[c.split()[1]]) for c in RESULT.split(", ")]))

    done = written(items.groupBy("block").cogroup(fetched.groupBy("block")).applyInArrow(summed, RESULT), folder, "done")
    numbers = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The parts of long texts, sorted by row and part, as one row for each text."""
        here, sums, digest, doc = None, None, None, None

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), *(pa.array([int(s)]) for s in sums), pa.array([digest.hexdigest()])], names=["doc", *numbers, "groups_sha256"])

        for batch in batches:
            values = [batch.column(c).to_pylist() for c in ("row", "doc", "groups_sha256", *numbers)]
            for row, d, joined, *n in zip(*values, strict=True):
                if row != here:
                    if here is not None:
                        yield flush()
                    here, doc, sums, digest = row, d, np.zeros(len(numbers), np.int64), sha256()
                    fresh = True
                if joined:
                    digest.update((joined if fresh else ";" + joined).encode())
                    fresh = False
                sums += n
        if here is not None:
            yield flush()

    single = done.filter("not piece").select("doc", *numbers, "groups_sha256")
    joined = done.filter("piece").repartition("row").sortWithinPartitions("row", "part").mapInArrow(hashed, "doc long, " + ", ".join(f"{n} long" for n in numbers) + ", groups_sha256 string")
    none = fragments.filter("part = 0").join(grows(bad), "row", "left_semi").select("doc", *(F.lit(0).cast("long").alias(n) for n in numbers), F.lit("").alias("groups_sha256"))
    out = written(single.unionByName(joined).unionByName(none), folder, "result")
    for name in ("short", "fragments", "bad", "longs", "pairs", "counts", "done", *(f"round-{k}" for k in range(12))):
        removed(spark, f"{folder}/{name}")
    return out.select(F.col("doc").alias(key), *numbers, "groups_sha256")


RESULT = "row long, doc long, part long, piece boolean, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
