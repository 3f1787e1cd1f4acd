"""Near duplicates by b-bit MinHash.

1. One pass over the texts gives each document a digest of its shingle set, band keys over full
   minima, and the packed low bits of the minima.
2. Equal sets form a class: a node of the graph, numbered when the classes are written. Copies are never paired.
   A key that occurs with several texts links the classes of all of them, whatever the order of rows.
3. Nodes that share a band key are candidates. Each bucket first compares its members with one pivot (the
   member with most company, so usually the original of a group of edited copies); pairs whose
   collision-corrected similarity, from bit counts of the packed signatures, is far below the threshold
   go, the others are confirmed on the full shingle sets: a pivot's set is read once for a slice of its partners.
4. Buckets that the confirmed links leave in several components are gone through exhaustively. Members of a bucket's
   largest component never meet each other; blocks of them meet blocks of the other members, and those each other,
   in units bounded in rows and in shingles: by bit counts first; members with a possible partner then
   meet again with their full sets, and only links between components leave the task. So no pair of a
   shared bucket is lost, and no group's pairs are spelt out.
5. The components of all links, brought back from classes to documents.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ASCII_LOWER, SPACED_WORD, STEP, mixed, removed, run_hashes, shared_dir, spans_of, text_slices, utf8, written
from .graph import connected_components

NIBBLES = 16


@dataclass(frozen=True)
class MinHash:
    """shingle words make a shingle; a link has 100 * |A & B| >= percent * |A | B|. bands * rows minima:
    a pair at 80 % is missed by every band with probability (1 - 0.8 ** rows) ** bands, 3e-6 here.
    deviations: how many standard deviations below the threshold a bit-count estimate may lie. A block holds about
    block rows and block_shingles shingles at most (one document, if it is longer); slice_rows partners share a copy of their pivot."""

    shingle: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 5
    deviations: float = 4.5
    block: int = 512
    block_shingles: int = 1 << 20
    slice_rows: int = 256

    @property
    def hashes(self) -> int:
        return self.bands * self.rows

    @property
    def least_equal(self) -> int:
        """Low-bit values that must agree: 1/16 agree by chance, which the estimate is corrected for."""
        p = 1 / NIBBLES + (1 - 1 / NIBBLES) * self.percent / 100
        return math.floor(self.hashes * p - self.deviations * math.sqrt(self.hashes * p * (1 - p)))


def grows(side: DataFrame) -> DataFrame:
    """A side of a join that grows with the corpus: it is never broadcast, so the plan is the same at every size."""
    return side.hint("merge")


def shingle_sets(part: pa.RecordBatch, text: str, k: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each row's text."""
    data, offsets = utf8(part.column(text))
    data = np.frombuffer(ASCII_LOWER, np.uint8)[data]
    starts, ends = spans_of(SPACED_WORD[data], offsets)
    words = run_hashes(data, starts, ends)
    border = np.searchsorted(starts, offsets)
    total = max(0, len(words) - k + 1)
    grams = np.zeros(total, np.uint64)
    for j in range(k):
        grams = grams * STEP + words[j : j + total]
    grams = mixed(grams)
    out = []
    for a, b in zip(border[:-1], border[1:], strict=True):
        if b - a >= k:
            one = np.sort(grams[a : b - k + 1])
            out.append(one[np.append(True, one[1:] != one[:-1])])
        elif b > a:
            whole = np.array([b - a], np.uint64)
            for w in words[a:b]:
                whole = whole * STEP + w
            out.append(mixed(whole))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray], cfg: MinHash) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (rows x bands) and packed low bits (rows x hashes / 16) of non-empty sets."""
    rng = np.random.default_rng(7)
    factor = rng.integers(1, 2**63, cfg.hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    salt = rng.integers(0, 2**63, cfg.hashes, dtype=np.uint64)
    minima = np.empty((cfg.hashes, len(sets)), np.uint64)
    sizes = np.array([len(s) for s in sets])
    at = 0
    while at < len(sets):  # about 32,000 shingles at once stay in the processor's cache
        end = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), 32768, side="right")))
        values, begins = np.concatenate(sets[at:end]), np.cumsum(sizes[at:end]) - sizes[at:end]
        for j in range(cfg.hashes):
            minima[j, at:end] = np.minimum.reduceat((values ^ salt[j]) * factor[j], begins)
        at = end
    keys = np.empty((len(sets), cfg.bands), np.uint64)
    for band in range(cfg.bands):
        key = np.full(len(sets), band, np.uint64)
        for j in range(band * cfg.rows, (band + 1) * cfg.rows):
            key = mixed(key * STEP + minima[j])
        keys[:, band] = key
    low = (minima ^ (minima >> np.uint64(32))) & np.uint64(NIBBLES - 1)
    packed = np.zeros((len(sets), cfg.hashes // 16), np.uint64)
    for j in range(cfg.hashes):
        packed[:, j // 16] |= low[j] << np.uint64(4 * (j % 16))
    return keys.view(np.int64), packed.view(np.int64)


def _sketches(docs: DataFrame, text: str, key: str, cfg: MinHash) -> DataFrame:
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("bands", longs), T.StructField("packed", longs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, text):
                sets = shingle_sets(part, text, cfg.shingle)
                full = [i for i, s in enumerate(sets) if len(s)]
                keys, packed = signatures([sets[i] for i in full], cfg) if full else (np.zeros((0, 1), np.int64), np.zeros((0, 1), np.int64))
                bands, low, digest = [None] * len(sets), [None] * len(sets), [None] * len(sets)
                for r, i in enumerate(full):
                    bands[i], low[i], digest[i] = keys[r], packed[r], _digest(sets[i])
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(low, pa.list_(pa.int64()))], names=schema.names)

    return docs.select(F.col(key).cast("long").alias("id"), text).mapInArrow(run, schema)


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _sets_of(docs: DataFrame, wanted: DataFrame, text: str, key: str, cfg: MinHash) -> DataFrame:
    """Rows (node, shingles) of wanted (rep, digest, node): the set of the document rep that has the digest. A
    repeated row gives one row a task, which later steps bear."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in text_slices(batch, text):
                nodes, digests, kept = part.column("node").to_pylist(), part.column("digest").to_pylist(), []
                for node, digest, one in zip(nodes, digests, shingle_sets(part, text, cfg.shingle), strict=True):
                    if node not in seen and _digest(one) == digest:
                        seen.add(node)
                        kept.append((node, one.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in kept], pa.int64()), pa.array([x for _, x in kept], pa.list_(pa.int64()))], names=["node", "shingles"])

    chosen = docs.select(F.col(key).cast("long").alias("rep"), F.col(text)).join(grows(wanted), "rep")
    return chosen.select(text, "digest", "node").mapInArrow(run, "node long, shingles array<long>")


def _equal_low_bits(x: str, y: str, cfg: MinHash) -> F.Column:
    """How many of the packed 4-bit values agree."""
    ones = F.lit(0x1111111111111111)
    total = F.lit(cfg.hashes)
    for i in range(cfg.hashes // 16):
        differs = F.col(x)[i].bitwiseXOR(F.col(y)[i])
        for shift in (1, 2):
            differs = differs.bitwiseOR(F.shiftrightunsigned(differs, shift))
        total = total - F.bit_count(differs.bitwiseAND(ones))
    return total


def _confirmed(pairs: DataFrame, sets: DataFrame, cfg: MinHash) -> DataFrame:
    """The pairs (hub, node) that are links on full shingle sets, as (a, b). A hub's partners are dealt to slices
    of bounded size; each slice reads the hub's set once, then its partners one after the other."""
    many = pairs.groupBy("hub").agg(F.ceil(F.count("*") / cfg.slice_rows).alias("slices"))
    dealt = pairs.join(grows(many), "hub").select("hub", "node", F.pmod(F.xxhash64("node"), F.col("slices")).alias("slice"))
    hubs = dealt.select("hub", "slice").distinct().select("hub", "slice", F.lit(0).alias("turn"), F.col("hub").alias("node"))
    rows = dealt.select("hub", "slice", F.lit(1).alias("turn"), "node").unionByName(hubs).join(grows(sets), "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, base = None, np.zeros(0, np.int64)
        for batch in batches:
            found = []
            lists = batch.column("shingles")
            flat, border = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            for k, (hub, part, turn, node) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("hub", "slice", "turn", "node")), strict=True)):
                mine = flat[border[k] : border[k + 1]]
                if turn == 0:
                    here, base = (hub, part), np.sort(mine)
                elif here == (hub, part):
                    at = np.minimum(np.searchsorted(base, mine), len(base) - 1)
                    shared = int((base[at] == mine).sum())
                    if 100 * shared >= cfg.percent * (len(base) + len(mine) - shared):
                        found.append((hub, node))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    return rows.repartition("hub", "slice").sortWithinPartitions("hub", "slice", "turn").mapInArrow(run, "a long, b long")


def _runs(frames: Iterator[pd.DataFrame], names: list[str]) -> Iterator[pd.DataFrame]:
    """The frames' rows, cut where one of the columns changes."""
    rest = None
    for frame in frames:
        frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        marks = frame[names].to_numpy()
        cuts = np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1
        for a, b in zip([0, *cuts[:-1]], cuts, strict=True) if len(cuts) else ():
            yield frame.iloc[a:b]
        rest = frame.iloc[cuts[-1] :] if len(cuts) else frame
    if rest is not None and len(rest):
        yield rest


UNIT = ["bucket", "i", "j"]


def _possible(unit: pd.DataFrame, cfg: MinHash) -> Iterator[tuple[int, np.ndarray]]:
    """For rows of a unit: the later rows that could be linked with it, by size and bit counts, that lie in
    another component, belong to this pair of blocks, and share no earlier band (where the pair is met too)."""
    i, j, bucket = unit["i"].iloc[0], unit["j"].iloc[0], unit["bucket"].iloc[0]
    own, component, n = (unit[c].to_numpy() for c in ("own", "component", "n"))
    packed, bands = np.stack(unit["packed"].to_numpy()).view(np.uint64), np.stack(unit["bands"].to_numpy())
    order = np.arange(len(unit))
    for x in order:
        meets = (own == j) | (own == i) if i == -1 and own[x] == j else own == (i if own[x] == j else j)
        y = np.flatnonzero(meets & (order > x) & (component != component[x]) & (100 * np.minimum(n, n[x]) >= cfg.percent * np.maximum(n, n[x])))
        if not len(y):
            continue
        d = packed[y] ^ packed[x]
        d |= d >> np.uint64(1)
        d |= d >> np.uint64(2)
        y = y[cfg.hashes - np.bitwise_count(d & np.uint64(0x1111111111111111)).sum(axis=1, dtype=np.int64) >= cfg.least_equal]
        y = y[bands[x, (bands[y] == bands[x]).argmax(axis=1)] == bucket] if len(y) else y
        if len(y):
            yield int(x), y


def _blocks(rows: DataFrame, cfg: MinHash) -> DataFrame:
    """For each bucket of rows: major, the component with most members, and how many blocks its members and the others make."""
    by_component = rows.groupBy("bucket", "component").agg(F.count("*").alias("members"), F.sum("n").alias("words"))
    need = lambda members, words: F.ceil(F.greatest(members / cfg.block, words / cfg.block_shingles)).cast("int")
    top = F.max(F.struct("members", (-F.col("component")).alias("less"), "words"))
    whole = by_component.groupBy("bucket").agg(top.alias("top"), F.sum("members").alias("members"), F.sum("words").alias("words"))
    return whole.select("bucket", (-F.col("top.less")).alias("major"), need(F.col("top.members"), F.col("top.words")).alias("majors"), need(F.col("members") - F.col("top.members"), F.col("words") - F.col("top.words")).alias("minors"))


def _units(rows: DataFrame, cfg: MinHash) -> DataFrame:
    """The rows (bucket, node, component, n, packed, bands) of open buckets that have a possible partner, by unit
    (i, j). Blocks of the major component are numbered -1, -2, ..., those of the other members 0, 1, ...; a unit is
    two blocks of which at most one is major, so a task holds two blocks at once. Minor members of one block meet in
    its unit with block -1. A major row is copied for each minor block, a minor one for all blocks."""
    cut = rows.join(grows(_blocks(rows, cfg)), "bucket").withColumn("large", F.col("component") == F.col("major"))
    block = F.pmod(F.xxhash64("node"), F.when(F.col("large"), F.col("majors")).otherwise(F.col("minors"))).cast("int")
    cut = cut.withColumn("own", F.when(F.col("large"), -1 - block).otherwise(block))
    others = F.filter(F.sequence(-F.col("majors"), F.col("minors") - 1), lambda o: F.when(F.col("large"), o >= 0).otherwise(o != F.col("own")))
    cut = cut.withColumn("other", F.explode(others))
    units = cut.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "component", "n", "packed", "bands")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for unit in _runs(frames, UNIT):
            wanted = np.zeros(len(unit), bool)
            for x, y in _possible(unit, cfg):
                wanted[x] = True
                wanted[y] = True
            if wanted.any():
                yield unit[wanted]

    return units.repartition(*UNIT).sortWithinPartitions(*UNIT).mapInPandas(run, units.schema)


def _unit_links(units: DataFrame, sets: DataFrame, cfg: MinHash) -> DataFrame:
    """Links (a, b) on full sets between different components of a unit; of the links that join the same two
    sides, one is enough."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for unit in _runs(frames, UNIT):
            nodes, component, n = (unit[c].to_numpy() for c in ("node", "component", "n"))
            sizes = np.array([len(s) for s in unit["shingles"]])
            begin = np.concatenate([[0], np.cumsum(sizes)])
            known, number = np.unique(np.concatenate(unit["shingles"].to_numpy()), return_inverse=True)
            flag, found = np.zeros(len(known), bool), []
            label = component.copy()
            for x, y in _possible(unit, cfg):
                y = y[label[y] != label[x]]
                if not len(y):
                    continue
                flag[number[begin[x] : begin[x + 1]]] = True
                places = np.concatenate([np.arange(begin[k], begin[k + 1]) for k in y])
                shared = np.add.reduceat(flag[number[places]].astype(np.int64), np.cumsum(sizes[y]) - sizes[y])
                flag[number[begin[x] : begin[x + 1]]] = False
                for k in y[100 * shared >= cfg.percent * (n[x] + n[y] - shared)]:
                    if label[k] != label[x]:
                        found.append((nodes[x], nodes[k]))
                        label[label == label[k]] = label[x]
            if found:
                yield pd.DataFrame(found, columns=["a", "b"])

    return units.join(grows(sets), "node").repartition(*UNIT).sortWithinPartitions(*UNIT, "node").mapInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", cfg: MinHash = MinHash()) -> DataFrame:
    """Rows (key as long, n_shingles, component_id, kept) for each row: component_id is the smallest
    key reachable over links, kept marks the document that has it.

    Words are runs of other characters than ASCII white space, A-Z lower-cased; a text with fewer words
    than a shingle is one shingle. Texts without words (null, empty, blank) link with nothing: their own
    key is their component. Rows that share a key count as one document, which
    has the links of all its texts that have words; each row has the n_shingles of its own text. A row whose key is null has a null
    component and is kept. Other columns are left out. An empty table gives no rows.
    """
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession)
    sketches = written(_sketches(docs, text, key, cfg), folder, "sketches")
    full = sketches.filter("digest is not null and id is not null")
    grouped = full.groupBy("digest").agg(F.min("id").alias("rep"), F.first(F.struct("n", "bands", "packed")).alias("sketch"))  # equal digests have equal sketches
    reps = written(grouped.select(F.monotonically_increasing_id().alias("node"), "rep", "digest", "sketch.n", "sketch.bands", "sketch.packed"), folder, "reps")

    # keys with several texts
    several = full.groupBy("id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).filter("x <> y").select("id")
    several = full.select("id", "digest").join(grows(several), "id", "left_semi").distinct().join(grows(reps.select("digest", "node")), "digest")
    several = written(several.select("id", "node"), folder, "several")
    least = several.groupBy("id").agg(F.min("node").alias("a"))
    same_key = several.join(grows(least), "id").filter("a <> node").select("a", F.col("node").alias("b"))

    members = reps.select("node", F.explode("bands").alias("bucket"))
    crowded = written(members.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1"), folder, "crowded")
    shared = written(members.join(grows(crowded), "bucket"), folder, "shared")
    company = written(shared.groupBy("node").agg(F.sum("members").alias("company")), folder, "company")
    best = F.max(F.struct("company", (-F.col("node")).alias("less"))).alias("best")
    pivots = written(shared.join(grows(company), "node").groupBy("bucket").agg(best).select("bucket", (-F.col("best.less")).alias("hub")), folder, "pivots")
    pairs = written(shared.join(grows(pivots), "bucket").filter("node <> hub").select("hub", "node").distinct(), folder, "pairs")

    low = reps.select("node", "packed")
    likely = pairs.join(grows(low.select(F.col("node").alias("hub"), F.col("packed").alias("low_a"))), "hub").join(grows(low.select("node", F.col("packed").alias("low_b"))), "node")
    likely = written(likely.filter(_equal_low_bits("low_a", "low_b", cfg) >= cfg.least_equal).select("hub", "node"), folder, "likely")
    wanted = reps.select("node", "rep", "digest").join(grows(company.select("node")), "node", "left_semi")
    sets = written(_sets_of(docs, wanted, text, key, cfg), folder, "sets")
    links = written(_confirmed(likely, sets, cfg).unionByName(same_key), folder, "links")
    groups = connected_components(links, f"{folder}/first")

    # buckets that still hold several components
    labelled = shared.select("node", "bucket").join(grows(groups), "node", "left").withColumn("component", F.coalesce("component", "node"))
    labelled = written(labelled, folder, "labelled")
    open_ = labelled.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("bucket")
    open_ = written(open_, folder, "open")
    rows = written(labelled.join(grows(open_), "bucket").join(grows(reps.select("node", "n", "packed", "bands")), "node"), folder, "rows")
    units = written(_units(rows, cfg), folder, "units")
    found = written(_unit_links(units, sets, cfg), folder, "links-more")
    if found.limit(1).count():
        groups = connected_components(links.union(found), f"{folder}/all")

    smallest = groups.join(grows(reps.select("node", "rep")), "node").groupBy("component").agg(F.min("rep").alias("smallest"))
    named = groups.join(grows(smallest), "component").select("node", "smallest")
    by_class = written(reps.select("node", "rep", "digest").join(grows(named), "node", "left").select("digest", F.coalesce("smallest", "rep").alias("component")), folder, "components")
    for name in ("several", "crowded", "shared", "company", "pivots", "pairs", "likely", "sets", "links", "first", "labelled", "open", "rows", "units", "links-more", "all", "reps"):
        removed(spark, f"{folder}/{name}")
    out = sketches.select("id", "n", "digest").join(grows(by_class), "digest", "left")
    own = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(F.col("id") == own, F.lit(True)).alias("kept"))
