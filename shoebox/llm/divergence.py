"""How far the sources of a language differ in their words: triangular discrimination over smoothed term shares, in whole numbers.

1. One pass over the texts counts each term of each (language, source) group, and in how many documents it is.
2. A language keeps the terms that enough of its documents have. Its matrix of groups by kept terms is cut into square tiles; terms
   of like frequency share tiles, so empty cells lie together. A tile with a count is a K-squared tree: each node tells which of its
   four quadrants hold a count, and counts stand at the leaves.
3. For two bands of groups, the trees over the same terms are walked together: a quadrant that is empty in both is priced at once for
   all its pairs of groups, as every term there has the same two shares; where one holds a count, all quarters
   are entered, down to the leaves. Terms whose tiles are empty in both bands are one large empty quadrant.
   Tiles over the same two bands are summed in the task before a number for each pair of groups leaves it.
4. The words that set a group apart from its language are ranked by a window that keeps ten on the map side.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import ASCII_LOWER, byte_class, removed, run_hashes, shared_dir, spans_of, text_slices, utf8, written
from .neardup import grows

TERM = byte_class(lambda i: i >= 128 or chr(i).isalpha())
SCALE = 1_000_000_000


@dataclass(frozen=True)
class Audit:
    """documents: how many of a language's documents a kept term is in. top: words ranked for each group. levels: a tile has 2 ** levels
    groups and terms. spread: tasks that the tiles over two bands of groups are dealt to."""

    documents: int = 10
    top: int = 10
    levels: int = 6
    spread: int = 16

    @property
    def side(self) -> int:
        return 1 << self.levels


def share(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / whole) for count + 2 <= whole, by long division in steps of 1,000: exact up to whole of 9e15."""
    out, rest = np.divmod(count + 2, whole)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + digit
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


class SquareTree:
    """A K-squared tree (K = 2) over cells (row, column) with counts. masks[l]: for each node of level l, bit k is set where quarter k
    (2 * lower half + right half) holds a count; the quarters of a level are the nodes of the next, in order; counts are those of the last."""

    def __init__(self, masks: list[np.ndarray], counts: np.ndarray):
        self.masks, self.counts = masks, counts
        self.before = [np.cumsum(np.bitwise_count(m), dtype=np.int64) - np.bitwise_count(m) for m in masks]

    @classmethod
    def of(cls, row: np.ndarray, column: np.ndarray, count: np.ndarray, levels: int) -> SquareTree:
        place = np.zeros(len(row), np.int64)
        for k in range(levels):
            place |= ((row >> k) & 1) << (2 * k + 1) | ((column >> k) & 1) << (2 * k)
        order = np.argsort(place)
        place, masks = place[order], []
        for level in range(levels):
            quarter = np.unique(place >> 2 * (levels - 1 - level))
            _, at = np.unique(quarter >> 2, return_inverse=True)
            mask = np.zeros(at[-1] + 1, np.uint8)
            np.bitwise_or.at(mask, at, (1 << (quarter & 3)).astype(np.uint8))
            masks.append(mask)
        return cls(masks, count[order])

    def packed(self) -> tuple[bytes, bytes]:
        return np.concatenate(self.masks).tobytes(), self.counts.astype(np.int64).tobytes()

    @classmethod
    def unpacked(cls, masks: bytes, counts: bytes, levels: int) -> SquareTree:
        flat, size, at, out = np.frombuffer(masks, np.uint8), 1, 0, []
        for _ in range(levels):
            out.append(flat[at : at + size])
            at, size = at + size, int(np.bitwise_count(out[-1]).sum())
        return cls(out, np.frombuffer(counts, np.int64))

    def quarter(self, level: int, node: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The node of quarter k of each node (-1: empty), or -1."""
        mask = np.where(node >= 0, self.masks[level][node], 0)
        rank = self.before[level][node] + np.bitwise_count(mask & ((1 << k) - 1).astype(np.uint8))
        return np.where((mask >> k) & 1, rank, -1)


def walked(x: SquareTree | None, y: SquareTree | None, rows: tuple[int, int], width: int, levels: int, same: bool) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """Walks two trees over the same width columns; rows: how many each has. Returns, for each pair of a row of x and one of y, how many columns lay in quadrants empty in both;
    and for the other columns the arrays (row of x, row of y, count of x, count of y). same: x and y are one tree, and only pairs of a row with a later one count."""
    side = 1 << levels
    corner = np.zeros((side + 1, side + 1), np.int64)
    node = [np.array([0 if t else -1]) for t in (x, y)]
    row_x = row_y = column = np.zeros(1, np.int64)
    for level in range(levels + 1):
        size = side >> level
        bare = (node[0] < 0) & (node[1] < 0)
        priced = np.clip(width - column[bare] * size, 0, size)
        low_x, low_y = row_x[bare] * size, row_y[bare] * size
        for a, b, sign in ((0, 0, 1), (size, 0, -1), (0, size, -1), (size, size, 1)):
            np.add.at(corner, (low_x + a, low_y + b), sign * priced)
        node, row_x, row_y, column = [n[~bare] for n in node], row_x[~bare], row_y[~bare], column[~bare]
        if level == levels:
            break
        half_x, half_y, right = (np.tile(h, len(row_x)) for h in ([0, 0, 0, 0, 1, 1, 1, 1], [0, 0, 1, 1, 0, 0, 1, 1], [0, 1, 0, 1, 0, 1, 0, 1]))
        node, row_x, row_y, column = [np.repeat(n, 8) for n in node], 2 * np.repeat(row_x, 8) + half_x, 2 * np.repeat(row_y, 8) + half_y, 2 * np.repeat(column, 8) + right
        node = [t.quarter(level, n, 2 * h + right) if t else n for t, n, h in zip((x, y), node, (half_x, half_y), strict=True)]
        keep = (row_x * (size // 2) < rows[0]) & (row_y * (size // 2) < rows[1]) & ((row_x <= row_y) | (not same))
        node, row_x, row_y, column = [n[keep] for n in node], row_x[keep], row_y[keep], column[keep]
    if same:
        keep = row_x < row_y
        node, row_x, row_y = [n[keep] for n in node], row_x[keep], row_y[keep]
    counts = [np.where(n >= 0, t.counts[n], 0) if t else np.zeros(len(n), np.int64) for t, n in zip((x, y), node, strict=True)]
    return corner.cumsum(axis=0).cumsum(axis=1)[:side, :side], (row_x, row_y, *counts)


def _counted(docs: DataFrame) -> DataFrame:
    """Rows (lang, source, term, n, docs), some with equal keys; each group has a row without a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text", 4 << 20):
                data, offsets = utf8(part.column("text"))
                data = np.frombuffer(ASCII_LOWER, np.uint8)[data]
                starts, ends = spans_of(TERM[data], offsets)
                _, first, word = np.unique(run_hashes(data, starts, ends), return_index=True, return_inverse=True)
                doc = np.searchsorted(offsets, starts, side="right") - 1
                codes = [pc.dictionary_encode(part.column(c)) for c in ("lang", "source")]
                index = [c.indices.to_numpy(zero_copy_only=False).astype(np.int64) for c in codes]
                group, group_of = np.unique(index[0] * (len(codes[1].dictionary) + 1) + index[1], return_inverse=True)
                member = np.unique(group_of, return_index=True)[1]
                cell = group_of[doc].astype(np.int64) * (len(first) + 1) + word
                known, n = np.unique(cell, return_counts=True)
                once = np.unique(cell * part.num_rows + doc) // max(part.num_rows, 1)
                in_docs = np.unique(once, return_counts=True)[1]
                raw = data.tobytes()
                terms = pa.array([raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)], pa.binary()).cast(pa.string())
                at_row = pa.array(np.concatenate([member[known // (len(first) + 1)], member]))
                names = [part.column(c).take(at_row) for c in ("lang", "source")]
                none = np.zeros(len(member), np.int64)
                term = pa.concat_arrays([terms.take(pa.array(known % (len(first) + 1))), pa.nulls(len(member), pa.string())])
                yield pa.RecordBatch.from_arrays([*names, term, pa.array(np.concatenate([n, none])), pa.array(np.concatenate([in_docs, none]))], names=["lang", "source", "term", "n", "docs"])

    return docs.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def _share(count: Column, whole: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / whole), exact."""
    return F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (count + 2).cast("decimal(19,0)"), whole.cast("decimal(19,0)")) + 1


def source_divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", cfg: Audit = Audit()) -> DataFrame:
    """Rows (lang, source, part, item, value, rank). Part pair: each other source of the language, the most different first, with the sum over
    kept terms of floor((p - q)^2 / (p + q)), p and q being 1 + floor(10^9 * (count + 2) / (N + 2 V)); part term: the cfg.top words
    that the group uses more than its language, by the same measure.

    Null texts, languages and sources count as ''. A group whose texts are all empty is a group; a language without kept terms has pairs of value
    0 and no words. Ties go to the item that is smaller in UTF-8. Repeated rows are documents of their own; a text of any
    length is one document; other columns are left out; an empty table gives no rows. Each two sources of a language give a pair, as the result asks for all ranks.
    """
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession)
    given = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((text, "text"), (lang, "lang"), (source, "source"))))
    cells = written(_counted(given).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), folder, "cells")
    terms = cells.filter("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= cfg.documents)
    terms = written(terms.select("lang", "term", F.col("n").alias("lang_n"), F.floor(F.log2("n")).cast("int").alias("band")), folder, "terms")
    langs = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    # columns: terms of a band of frequency are dealt to tiles by hash
    bands = terms.groupBy("lang", "band").agg(F.ceil(F.count("*") / (0.75 * cfg.side)).alias("tiles"))
    spread = terms.join(bands, ["lang", "band"]).withColumn("tile", F.pmod(F.xxhash64("term"), F.col("tiles")))
    number = F.row_number().over(W.Window.partitionBy("lang", "band", "tile").orderBy("term")) - 1
    columns = spread.withColumn("number", number).select("lang", "term", "lang_n", F.xxhash64("lang", "band", "tile", F.floor(F.col("number") / cfg.side)).alias("tile"), (F.col("number") % cfg.side).alias("column"))
    columns = written(columns, folder, "columns")
    width = columns.groupBy("lang", "tile").agg(F.count("*").cast("int").alias("width"))
    kept = written(cells.join(columns, ["lang", "term"]), folder, "kept")
    # rows: the groups of a language, by name
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    order = W.Window.partitionBy("lang").orderBy("source")
    groups = cells.select("lang", "source").distinct().withColumn("number", F.row_number().over(order) - 1).join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    whole = F.coalesce("total", F.lit(0)) + 2 * F.coalesce("v", F.lit(0))
    groups = written(groups.select("lang", "source", "number", F.coalesce("v", F.lit(0)).alias("v"), "lang_total", whole.alias("whole")), folder, "groups")

    cut = kept.join(groups.select("lang", "source", "number"), ["lang", "source"]).select("lang", "tile", F.floor(F.col("number") / cfg.side).alias("band"), (F.col("number") % cfg.side).alias("row"), "column", "n")

    def planted(key: tuple, table: pa.Table) -> pa.Table:
        masks, counts = SquareTree.of(*(table[c].to_numpy().astype(np.int64) for c in ("row", "column", "n")), cfg.levels).packed()
        return pa.table({"lang": [key[0].as_py()], "tile": [key[1].as_py()], "band": [key[2].as_py()], "masks": [masks], "counts": [counts]})

    trees = cut.groupBy("lang", "tile", "band").applyInArrow(planted, "lang string, tile long, band long, masks binary, counts binary")
    trees = written(trees.join(width, ["lang", "tile"]), folder, "trees")
    slots = groups.groupBy("lang", F.floor(F.col("number") / cfg.side).alias("band")).agg(F.sort_array(F.collect_list(F.struct("number", "whole"))).alias("members"))  # cfg.side at most
    slots = slots.select("lang", "band", F.col("members.whole").alias("whole"))
    other = slots.select("lang", F.col("band").alias("band_y"), F.col("whole").alias("whole_y"))
    matched = slots.select("lang", F.col("band").alias("band_x"), F.col("whole").alias("whole_x")).join(other, "lang").filter("band_x <= band_y")
    matched = written(matched, folder, "matched")
    left = trees.select("lang", "tile", "width", F.col("band").alias("band_x"), F.col("masks").alias("masks_x"), F.col("counts").alias("counts_x"))
    right = trees.select("lang", "tile", "width", F.col("band").alias("band_y"), F.col("masks").alias("masks_y"), F.col("counts").alias("counts_y"))
    # each tile of a band meets all bands of its language: as the first, as the second, and with itself once
    first = matched.join(left, ["lang", "band_x"]).select("lang", "band_x", "band_y", "tile", "width", "masks_x", "counts_x", F.lit(None).cast("binary").alias("masks_y"), F.lit(None).cast("binary").alias("counts_y"))
    second = matched.filter("band_x < band_y").join(right, ["lang", "band_y"]).select("lang", "band_x", "band_y", "tile", "width", F.lit(None).cast("binary").alias("masks_x"), F.lit(None).cast("binary").alias("counts_x"), "masks_y", "counts_y")
    both = first.unionByName(second).groupBy("lang", "band_x", "band_y", "tile").agg(F.first("width").alias("width"), *(F.max(c).alias(c) for c in ("masks_x", "counts_x", "masks_y", "counts_y")))
    work = both.withColumn("deal", F.pmod(F.xxhash64("tile"), F.lit(cfg.spread)).cast("int")).unionByName(matched.select("lang", "band_x", "band_y", F.lit(0).alias("deal")), allowMissingColumns=True)
    work = work.join(matched, ["lang", "band_x", "band_y"])
    deal = ("lang", "band_x", "band_y", "deal")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = None

        def flush() -> pa.RecordBatch:
            name, bx, by, _ = here
            i, j = np.nonzero(np.ones((len(wx), len(wy)), bool))
            if bx == by:
                i, j = i[i < j], j[i < j]
            n = len(i)
            return pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(bx * cfg.side + i), pa.array(by * cfg.side + j), pa.array(total[i, j]), pa.array(np.full(n, seen))], names=["lang", "x", "y", "value", "seen"])

        for batch in batches:
            for r in batch.to_pylist():
                now = tuple(r[c] for c in deal)
                if now != here:
                    if here is not None:
                        yield flush()
                    here, seen, wx, wy = now, 0, np.array(r["whole_x"]), np.array(r["whole_y"])
                    total = np.zeros((len(wx), len(wy)), np.int64)
                if r["tile"] is None:
                    continue
                tree_x = SquareTree.unpacked(r["masks_x"], r["counts_x"], cfg.levels) if r["masks_x"] else None
                same = now[1] == now[2]
                tree_y = tree_x if same else SquareTree.unpacked(r["masks_y"], r["counts_y"], cfg.levels) if r["masks_y"] else None
                empty, (x, y, n, m) = walked(tree_x, tree_y, (len(wx), len(wy)), r["width"], cfg.levels, same)
                none = divergence(share(np.zeros_like(wx), wx)[:, None], share(np.zeros_like(wy), wy)[None, :])
                total += none * empty[: len(wx), : len(wy)]
                np.add.at(total, (x, y), divergence(share(n, wx[x]), share(m, wy[y])))
                seen += r["width"]
        if here is not None:
            yield flush()

    partial = work.repartition(*deal).sortWithinPartitions(*deal).mapInArrow(summed, "lang string, x long, y long, value long, seen long")
    sums_ = partial.groupBy("lang", "x", "y").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    name = lambda side: groups.select("lang", F.col("number").alias(side), F.col("source").alias(f"source_{side}"), F.col("whole").alias(f"whole_{side}"), F.col("v").alias(f"v_{side}"))
    named = sums_.join(grows(name("x")), ["lang", "x"]).join(grows(name("y")), ["lang", "y"])
    p, q = (_share(F.lit(0), F.when(F.col(w) > 0, F.col(w))) for w in ("whole_x", "whole_y"))
    rest = (F.col("v_x") - F.col("seen")) * F.call_function("div", (p - q) * (p - q), p + q)  # tiles that are empty in both bands
    named = written(named.select("lang", "source_x", "source_y", (F.col("value") + F.coalesce(rest, F.lit(0))).alias("value")), folder, "pairs")
    pairs = named.select("lang", F.col("source_x").alias("source"), F.lit("pair").alias("part"), F.col("source_y").alias("item"), "value")
    pairs = pairs.unionByName(named.select("lang", F.col("source_y").alias("source"), F.lit("pair").alias("part"), F.col("source_x").alias("item"), "value"))
    by = W.Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(by))

    words = kept.join(groups.select("lang", "source", "v", "lang_total", "whole"), ["lang", "source"])
    words = words.withColumns({"p": _share(F.col("n"), F.col("whole")), "q": _share(F.col("lang_n"), F.col("lang_total") + 2 * F.col("v"))}).filter("n > 0 and p > q")
    words = words.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.call_function("div", (F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("p") + F.col("q")).alias("value"))
    words = words.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= cfg.top)
    out = written(pairs.unionByName(words), folder, "result")
    for table in ("cells", "terms", "columns", "kept", "groups", "trees", "matched", "pairs"):
        removed(spark, f"{folder}/{table}")
    return out
