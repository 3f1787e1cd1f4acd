"""Benchmark decontamination with one Aho-Corasick automaton over the words of benchmark items.

Texts are normalised to lower-case words, and words to numbers of the benchmark's vocabulary. Each run of
`window` words of an item (an item with fewer words: all of it) is a pattern. The automaton lives in a few
numpy arrays: its edges sorted by (state, word), the failure link of each state, and the patterns that end in
it. It reads every text once, many stretches of text side by side, and places found are
mapped back to words, and on to the original text. Unknown words lead to the root, so only
stretches of known words are read.

A benchmark has about thirteen states a word of 32 bytes each: some 52 MB for each MB of text, and about three times that while
it is built. The items are dealt to parts of about `part_bytes` of text, one automaton each: a benchmark has one part, unless it is
larger than that. Several parts are searched one after the other, each with a scan of the texts, their automata
are released at once, and what they find is put together by text, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM_WORD, ASCII_LOWER, removed, run_hashes, shared_dir, spans_of, text_slices, utf8, written

_STRETCH = 256


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of lowered bytes, and their hashes."""
    starts, ends = spans_of(ALNUM_WORD[data], offsets)
    return starts, ends, run_hashes(data, starts, ends)


def words_of(text: str | None) -> list[bytes]:
    low = (text or "").encode().translate(ASCII_LOWER)
    return bytes(c if ALNUM_WORD[c] else 32 for c in low).split()


@dataclass
class Automaton:
    """edges: sorted (state * (vocabulary size + 1) + word), the edge at place e leads to state e + 1; 0 is the root.
    ends: the pattern that ends in a state, or -1; also: the longest proper suffix of a state in which one ends, or 0.
    items[item_cut[p] : item_cut[p + 1]]: the items of pattern p; lengths: its words."""

    vocabulary: np.ndarray
    edges: np.ndarray
    fail: np.ndarray
    ends: np.ndarray
    also: np.ndarray
    lengths: np.ndarray
    items: np.ndarray
    item_cut: np.ndarray

    @property
    def shortest(self) -> int:
        return int(self.lengths.min()) if len(self.lengths) else 1 << 30

    @property
    def longest(self) -> int:
        return int(self.lengths.max()) if len(self.lengths) else 0

    def step(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The edge of each state by its word; -1 where there is none."""
        if not len(self.edges):
            return np.full(len(state), -1, np.int64)
        code = state * (len(self.vocabulary) + 1) + word
        at = np.minimum(np.searchsorted(self.edges, code), len(self.edges) - 1)
        return np.where(self.edges[at] == code, at + 1, -1)

    def read(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The next state: failure links are followed until there is an edge, or the root has none."""
        out, todo, now = np.zeros(len(state), np.int64), np.arange(len(state)), state
        while len(todo):
            to = self.step(now, word[todo])
            done = (to >= 0) | (now == 0)
            out[todo[done]] = np.maximum(to[done], 0)
            todo, now = todo[~done], self.fail[now[~done]]
        return out


def build(texts: list[str | None], numbers: list[int], window: int) -> Automaton:
    """The automaton of the items, level by level: the states of depth d are the distinct pairs of a state of depth
    d - 1 and a word. All windows of all items grow side by side."""
    data, offsets = utf8(pa.array(texts, pa.string()))
    starts, _, hashes = _words(np.frombuffer(ASCII_LOWER, np.uint8)[data], offsets)
    vocabulary, word = np.unique(hashes, return_inverse=True)
    count = np.diff(np.searchsorted(starts, offsets))
    size = np.minimum(count, window)
    first = np.cumsum(count) - count
    many = np.where(count > 0, count - size + 1, 0)
    begin = np.arange(int(many.sum())) + np.repeat(first - (np.cumsum(many) - many), many)
    length, item = np.repeat(size, many), np.repeat(np.array(numbers, np.int64), many)
    base, state, edges, known, final = len(vocabulary) + 1, np.zeros(len(begin), np.int64), [], 0, np.zeros(len(begin), np.int64)
    parents = [np.zeros(1, np.int64)]
    for depth in range(int(length.max()) if len(length) else 0):
        alive = np.flatnonzero(length > depth)
        code, number = np.unique(state[alive] * base + word[begin[alive] + depth], return_inverse=True)
        edges.append(code)
        parents.append(code // base)
        state[alive] = number + known + 1
        known += len(code)
        over = alive[length[alive] == depth + 1]
        final[over] = state[over]
    order = np.lexsort((item, final))
    pairs = np.unique(np.stack([final[order], item[order]]), axis=1) if len(order) else np.zeros((2, 0), np.int64)
    heads, cut = np.unique(pairs[0], return_index=True)
    lengths = np.zeros(len(heads), np.int64)
    lengths[np.searchsorted(heads, final)] = length
    ends = np.full(known + 1, -1, np.int64)
    ends[heads] = np.arange(len(heads))
    out = Automaton(vocabulary, np.concatenate(edges or [np.zeros(0, np.int64)]), np.zeros(known + 1, np.int64), ends, np.zeros(known + 1, np.int64), lengths, pairs[1], np.append(cut, pairs.shape[1]))
    at = 0
    for depth, level in enumerate(edges):
        states = np.arange(at + 1, at + len(level) + 1)
        if depth:
            out.fail[states] = out.read(out.fail[level // base], level % base)
            behind = out.fail[states]
            out.also[states] = np.where(ends[behind] >= 0, behind, out.also[behind])
        at += len(level)
    return out


def occurrences(automaton: Automaton, word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(end, pattern) of all places of patterns in texts of words (numbers, -1: unknown), cut by offsets; end is
    exclusive. Stretches of known words are read in lanes that begin longest - 1 words early."""
    starts, ends = spans_of(word >= 0, offsets)
    long_enough = ends - starts >= automaton.shortest
    starts, ends = starts[long_enough], ends[long_enough]
    pieces = -(-(ends - starts) // _STRETCH)
    owner = np.repeat(np.arange(len(starts)), pieces)
    low = starts[owner] + _STRETCH * (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    high, early = np.minimum(low + _STRETCH, ends[owner]), np.maximum(low - max(automaton.longest - 1, 0), starts[owner])
    order = np.argsort(early - high, kind="stable")
    low, high, early = low[order], high[order], early[order]
    state, at, what = np.zeros(len(low), np.int64), [], []
    down = early - high
    for t in range(int(-down[0]) if len(down) else 0):
        here = int(np.searchsorted(down, -t, side="left"))
        place = early[:here] + t
        state = automaton.read(state[:here], word[place])
        hit = np.where(automaton.ends[state] >= 0, state, automaton.also[state])
        own = np.flatnonzero((hit > 0) & (place >= low[:here]))
        hit = hit[own]
        while len(own):
            at.append(place[own] + 1)
            what.append(automaton.ends[hit])
            hit = automaton.also[hit]
            own, hit = own[hit > 0], hit[hit > 0]
    none = [np.zeros(0, np.int64)]
    return np.concatenate(at or none), np.concatenate(what or none)


@dataclass
class _Texts:
    """The words of a column of texts: their bytes, starts, ends and hashes; border cuts them into texts."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    border: np.ndarray

    @staticmethod
    def of(column: pa.Array) -> _Texts:
        data, offsets = utf8(column)
        starts, ends, hashes = _words(np.frombuffer(ASCII_LOWER, np.uint8)[data], offsets)
        return _Texts(data, offsets, starts, ends, hashes, np.searchsorted(starts, offsets))

    def places(self, automaton: Automaton) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and last (exclusive) word of each occurrence in the column, and its pattern."""
        at = np.minimum(np.searchsorted(automaton.vocabulary, self.hashes), max(len(automaton.vocabulary) - 1, 0))
        known = automaton.vocabulary[at] == self.hashes if len(automaton.vocabulary) else np.zeros(len(at), bool)
        last, pattern = occurrences(automaton, np.where(known, at, -1), self.border)
        return last - automaton.lengths[pattern], last, pattern

    def found_items(self, automaton: Automaton, first: np.ndarray, pattern: np.ndarray) -> list[np.ndarray]:
        """The distinct numbers of the items found in each text."""
        count = np.diff(automaton.item_cut)[pattern]
        which = automaton.items[np.repeat(automaton.item_cut[pattern] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))]
        row = np.repeat(np.searchsorted(self.border, first, side="right") - 1, count)
        pairs = np.unique(np.stack([row, which]), axis=1) if len(row) else np.zeros((2, 0), np.int64)
        return np.split(pairs[1], np.searchsorted(pairs[0], np.arange(1, len(self.border) - 1))) if len(self.border) > 1 else []

    def hits(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, list[list[dict]]]:
        """How many words of each text lie in places, and the passages they make, in code points."""
        turn = np.bincount(first, minlength=len(self.starts) + 1) - np.bincount(last, minlength=len(self.starts) + 1)
        hit = np.cumsum(turn)[:-1] > 0
        total = np.concatenate([[0], np.cumsum(hit)])
        spans: list[list[dict]] = [[] for _ in self.border[:-1]]
        a, b = spans_of(hit, self.border)
        rows = np.searchsorted(self.border, a, side="right") - 1
        for row in np.unique(rows):
            low, high = self.offsets[row], self.offsets[row + 1]
            point = np.cumsum((self.data[low:high] & 0xC0) != 0x80)
            mine = rows == row
            spans[row] = [{"start": int(point[x - low] - 1), "end": int(point[y - low - 1])} for x, y in zip(self.starts[a[mine]], self.ends[b[mine] - 1], strict=True)]
        return np.diff(total[self.border]), spans


def contaminated_words(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id", window: int = 13, part_bytes: int = 1 << 20, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (key, keep..., n_words, n_hit, items array, hit_spans array<struct<start, end>>) for each document:
    its words, those inside an occurrence of a window, the item keys whose windows occur, in their order, and
    the hit passages as code points of the original text.

    Null and empty texts have no words. Items without words have no window; repeated items count
    once. Repeated documents each give a row and null keys are kept; an empty table gives no rows. Columns other than
    keep are left out. There is no limit to the benchmark: about part_bytes of it are in the driver and in a task
    at once, and what several parts find is put together by the digest of the text.
    """
    size = benchmark.agg(F.sum(F.octet_length(item_text))).first()[0] or 0
    parts = max(1, -(-size // part_bytes))
    items = benchmark.filter(F.col(item_text).isNotNull()).select(F.col(item_key).alias("item"), F.col(item_text).alias("value"), F.pmod(F.xxhash64(item_text), F.lit(parts)).alias("part")).distinct()
    item_type = T.ArrayType(benchmark.schema[item_key].dataType)
    place_type = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())]))
    span_type = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    counts = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType())]
    kept = [docs.schema[c] for c in dict.fromkeys([key, *keep])]
    names = [f.name for f in kept]
    if parts == 1:
        whole = T.StructType([*kept, *counts, T.StructField("items", item_type), T.StructField("hit_spans", span_type)])
        return docs.select(*dict.fromkeys([*names, text])).mapInArrow(_search(docs, items, text, window, whole, names, True)[0], whole)
    folder, hashed = shared_dir(docs.sparkSession), F.sha2(F.col(text).cast("binary"), 256).alias("sha")
    by_text = T.StructType([T.StructField("sha", T.StringType()), T.StructField("places", place_type), T.StructField("items", item_type)])
    found = []
    for p in range(parts):
        search, sent = _search(docs, items.filter(F.col("part") == p), text, window, by_text, ["sha"], False)
        one = docs.select(hashed, text).mapInArrow(search, by_text)
        found.append(written(one.filter(F.size("items") > 0).dropDuplicates(["sha"]), folder, f"part-{p}"))
        sent.destroy()
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    every = every.groupBy("sha").agg(F.flatten(F.collect_list("places")).alias("places"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))  # a row a part at most
    every = written(every, folder, "found")
    for p in range(parts):
        removed(docs.sparkSession, f"{folder}/part-{p}")
    marked = docs.select(*dict.fromkeys([*names, text]), hashed.alias("sha of text")).join(every.withColumnRenamed("sha", "sha of text").select("sha of text", F.struct("places", "items").alias("found in parts")), "sha of text", "left").drop("sha of text")
    schema = T.StructType([*kept, *counts, T.StructField("hit_spans", span_type), T.StructField("places of items", T.StructType([T.StructField("places", place_type), T.StructField("items", item_type)]))])
    counted = marked.mapInArrow(_counted(text, schema, names), schema)
    return counted.select(*names, "n_words", "n_hit", F.coalesce(F.col("places of items")["items"], F.array().cast(item_type)).alias("items"), "hit_spans")


def _search(docs: DataFrame, items: DataFrame, text: str, window: int, schema: T.StructType, kept: list[str], whole: bool):
    """A function over batches that searches texts for the windows of items, and the broadcast it reads; whole: with counts and spans, else with places."""
    rows = items.select("item", "value").collect()  # one part
    known = sorted({r["item"] for r in rows}, key=lambda i: (i is None, i))
    number = {x: i for i, x in enumerate(known)}
    automaton = build([r["value"] for r in rows], [number[r["item"]] for r in rows], window)
    sent = docs.sparkSession.sparkContext.broadcast((automaton, known))
    arrow = _arrow_types(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, names = sent.value
        for batch in batches:
            for part in text_slices(batch, text):
                texts = _Texts.of(part.column(text))
                first, last, pattern = texts.places(own)
                items = [[names[i] for i in x] for x in texts.found_items(own, first, pattern)]
                columns = {c: part.column(c) for c in kept} | {"items": pa.array(items, arrow["items"])}
                if whole:
                    n_hit, spans = texts.hits(first, last)
                    columns |= {"n_words": pa.array(np.diff(texts.border), pa.int64()), "n_hit": pa.array(n_hit, pa.int64()), "hit_spans": pa.array(spans, arrow["hit_spans"])}
                else:
                    places: list[list[dict]] = [[] for _ in range(part.num_rows)]
                    for a, b, row in zip(first.tolist(), last.tolist(), (np.searchsorted(texts.border, first, side="right") - 1).tolist(), strict=True):
                        places[row].append({"first": a - int(texts.border[row]), "last": b - int(texts.border[row])})
                    columns["places"] = pa.array(places, arrow["places"])
                yield pa.RecordBatch.from_arrays([columns[f.name] for f in schema.fields], names=schema.names)

    return run, sent


def _counted(text: str, schema: T.StructType, kept: list[str]):
    """A function over batches that counts what all parts found: (n_words, n_hit, hit_spans) from the places in `found in parts`."""
    arrow = _arrow_types(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, text):
                texts, found = _Texts.of(part.column(text)), part.column("found in parts")
                pairs = [(int(texts.border[row]) + p["first"], int(texts.border[row]) + p["last"]) for row, f in enumerate(found.to_pylist()) if f for p in f["places"]]
                n_hit, spans = texts.hits(*np.array(pairs, np.int64).reshape(-1, 2).T)
                columns = {c: part.column(c) for c in kept} | {"n_words": pa.array(np.diff(texts.border), pa.int64()), "n_hit": pa.array(n_hit, pa.int64()), "hit_spans": pa.array(spans, arrow["hit_spans"]), "places of items": found}
                yield pa.RecordBatch.from_arrays([columns[f.name] for f in schema.fields], names=schema.names)

    return run


def _arrow_types(schema: T.StructType) -> dict[str, pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return {f.name: to_arrow_type(f.dataType) for f in schema.fields}


def is_contaminated(n_hit, n_words):
    """The contract's rule: a twentieth of the words or more lie inside benchmark windows."""
    return (n_hit > 0) & (20 * n_hit >= n_words)
