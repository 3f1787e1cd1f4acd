"""Near duplicates among embeddings by iterative quantisation and multi-index Hamming tables.

1. Equal vectors form a class, which is compared once. From a bounded sample of classes rotations are learnt that bring the
   centred vectors close to balanced binary codes (sign against the median of each rotated coordinate); the codes of
   several rotations stand one behind the other.
2. A code is cut into substrings, one for each table. Vectors whose codes agree in a whole substring share a bucket,
   so with t tables no pair within Hamming distance t - 1 is missed. The substring is as long as buckets need to stay small, and tables
   are added until pairs made at exactly the least cosine, from the sample, are missed by all tables rarely enough.
3. Within a bucket, bit counts over the first bits of the codes tell possible partners. Only these meet with their
   original vectors, and the exact cosine decides. A pair that shares several buckets is counted in the first.
4. Large clumps of near copies are balls: centres come from the sample, and vectors within half of the linking angle
   of a centre are linked with each other for certain. Their pairs are counted by the ball's size, never compared. So buckets of a ball make no work within it.
5. A unit of work is two blocks of a bucket, of bounded size. What leaves it is one row for each of its vectors: the number of
   links, and the root of its component there. No pair leaves a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b
from math import acos, ceil, cos, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, commonest_size, dense, removed, shared_dir, usable, written
from .graph import connected_components
from .neardup import grows


@dataclass(frozen=True)
class Quantisation:
    """cosine links. sample, sample_bytes: what rotations and ball centres are learnt from (every vector is indexed). miss: the share of
    pairs at exactly the least cosine that all tables together may miss. bits: the most bits of one rotation;
    rotations: refinement rounds. crowd: vectors that a bucket should hold. block: vectors of a bucket that meet at once.
    heavy: members in the sample that make a ball. hot: classes with more than this share of all rows are joined by broadcast (1 / hot at most)."""

    cosine: float = 0.9
    sample: int = 8192
    sample_bytes: int = 16 << 20
    miss: float = 0.03
    bits: int = 64
    rounds: int = 30
    crowd: int = 64
    tables: int = 192
    block: int = 512
    heavy: int = 8
    hot: float = 0.001
    salts: int = 16
    seed: int = 11


CHECKED = 128  # bits of a code that go into a bucket


@dataclass
class Codes:
    """mean and basis (dimension x bits) make rotated coordinates, which are compared with median. Substring t is bits t * width up to (t + 1) * width.
    most: Hamming distance over the checked bits that a link may have. centres: unit vectors of the balls; a ball's members lie within half the linking angle."""

    mean: np.ndarray
    basis: np.ndarray
    median: np.ndarray
    width: int
    tables: int
    most: int
    centres: np.ndarray
    half: float

    def bits(self, units: np.ndarray) -> np.ndarray:
        return (units - self.mean) @ self.basis > self.median

    def substrings(self, bits: np.ndarray) -> np.ndarray:
        """One number for each row and table."""
        weights = 1 << np.arange(self.width, dtype=np.int64)
        return bits[:, : self.width * self.tables].reshape(len(bits), self.tables, self.width) @ weights

    def balls(self, units: np.ndarray) -> np.ndarray:
        """The nearest ball that each row lies in, or -1."""
        if not len(self.centres) or not len(units):
            return np.full(len(units), -1, np.int32)
        near = units @ self.centres.T
        best = near.argmax(axis=1)
        return np.where(near[np.arange(len(units)), best] >= self.half, best, -1).astype(np.int32)


def checked_words(bits: np.ndarray) -> np.ndarray:
    """The first bits as two 64-bit words a row."""
    return np.packbits(bits[:, :CHECKED], axis=1, bitorder="little").view(np.uint64)


def learnt_rotation(projected: np.ndarray, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """A rotation under which the rows lie close to the corners of a cube: the codes and the rotation that fits them best are found in turns."""
    rotation = np.linalg.qr(rng.normal(size=(projected.shape[1],) * 2))[0]
    for _ in range(rounds):
        corners = np.sign(projected @ rotation)
        left, _, right = np.linalg.svd(corners.T @ projected)
        rotation = (left @ right).T
    return rotation


def ball_centres(units: np.ndarray, cfg: Quantisation) -> np.ndarray:
    """Centres of clumps with cfg.heavy members in the sample, largest first; at most len(units) / cfg.heavy."""
    half = cos(acos(cfg.cosine) / 2)
    company = np.concatenate([(units[a : a + 256] @ units.T >= cfg.cosine).sum(axis=1) for a in range(0, len(units), 256)]) if len(units) else np.zeros(0, int)
    free, out = company >= cfg.heavy, []
    for at in np.argsort(-company, kind="stable"):
        if not free[at]:
            continue
        members = free & (units @ units[at] >= cfg.cosine)
        free[at] = False
        if members.sum() < cfg.heavy:
            continue
        centre = units[members].mean(axis=0)
        centre /= np.linalg.norm(centre)
        members = free & (units @ centre >= half)
        if members.sum() + 1 >= cfg.heavy:
            out.append(centre)
            free &= ~members
    return np.array(out).reshape(len(out), units.shape[1])


def learnt_codes(vectors: np.ndarray, n: int, cfg: Quantisation) -> Codes:
    """Rotations, table width and number of tables for n vectors, from a sample of them."""
    rng, dimension = np.random.default_rng(cfg.seed), vectors.shape[1]
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    mean = units.mean(axis=0)
    size = min(dimension, cfg.bits)
    axes = np.linalg.eigh((units - mean).T @ (units - mean))[1][:, ::-1][:, :size]
    width = int(np.clip(round(log2(max(n, 1) / cfg.crowd + 1)), 4, 24))
    # pairs at exactly the least cosine: each vector is turned towards another one, as data differ from each other
    some = units[rng.permutation(len(units))[:2048]]
    other = units[rng.integers(0, len(units), len(some))] + 1e-3 * rng.normal(size=some.shape)
    other -= (other * some).sum(axis=1, keepdims=True) * some
    other /= np.maximum(np.linalg.norm(other, axis=1, keepdims=True), 1e-12)
    turned = cfg.cosine * some + np.sqrt(1 - cfg.cosine**2) * other
    bases, medians, same = [], [], []
    rounds = cfg.rounds if size >= 16 else 0  # few coordinates have one best rotation; there random ones differ more
    missed, tables, bits = np.ones(len(some), bool), 0, 0
    while (missed.mean() > cfg.miss or bits < max(CHECKED, width)) and tables < cfg.tables:
        rotation = learnt_rotation((units - mean) @ axes, rounds, rng)
        basis = axes @ rotation
        bases.append(basis)
        medians.append(np.median((units - mean) @ basis, axis=0))
        same.append(((some - mean) @ basis > medians[-1]) == ((turned - mean) @ basis > medians[-1]))
        bits += size
        equal = np.hstack(same)
        while (tables + 1) * width <= bits and missed.mean() > cfg.miss:
            missed &= ~equal[:, tables * width : (tables + 1) * width].all(axis=1)
            tables += 1
    apart = (~np.hstack(same)[:, :CHECKED]).sum(axis=1)
    most = int(np.quantile(apart, 0.998)) + 2
    half = cos((acos(cfg.cosine) - 1e-4) / 2)
    return Codes(mean, np.hstack(bases), np.concatenate(medians), width, tables, most, ball_centres(units, cfg), half)


def partners(unit: np.ndarray, two: np.ndarray, own: np.ndarray, ball: np.ndarray, table: np.ndarray, words: np.ndarray, codes: Codes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (sorted by unit) that may be linked, as index arrays: rows of one unit, of different blocks where it is one of two blocks, not of
    one ball, near by bit counts, and not met in an earlier table of the checked bits."""
    n = len(unit)
    if not n:
        return
    first = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
    size = np.diff(np.append(first, n))
    stop = np.repeat(first + size, size)
    spread = np.arange(codes.tables)[:, None] * codes.width + np.arange(codes.width)
    masks = [checked_words(np.isin(np.arange(CHECKED), s)[None, :])[0] for s in spread if s[-1] < CHECKED]
    rows = np.arange(n)
    for lag in range(1, int(size.max())):
        rows = rows[rows + lag < stop[rows]]
        x, y = rows, rows + lag
        keep = (~two[x] | (own[x] != own[y])) & ((ball[x] != ball[y]) | (ball[x] < 0))
        x, y = x[keep], y[keep]
        apart = words[x] ^ words[y]
        keep = np.bitwise_count(apart).sum(axis=1, dtype=np.int64) <= codes.most
        x, y, apart = x[keep], y[keep], apart[keep]
        fresh = np.ones(len(x), bool)
        for t, mask in enumerate(masks):
            fresh &= (table[x] <= t) | ((apart & mask).any(axis=1))
        if fresh.any():
            yield x[fresh], y[fresh]


def _whole_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables that end with a whole unit; rows come sorted by bucket, i, j."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rest = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        marks = [rest[c].to_numpy() for c in ("bucket", "i", "j")]
        changes = np.flatnonzero(np.any([m[1:] != m[:-1] for m in marks], axis=0))
        if len(changes):
            yield rest.slice(0, int(changes[-1]) + 1)
            rest = rest.slice(int(changes[-1]) + 1)
    if rest is not None:
        yield rest


def _unit_numbers(part: pa.Table) -> np.ndarray:
    marks = [part[c].to_numpy() for c in ("bucket", "i", "j")]
    return np.cumsum(np.append(0, np.any([m[1:] != m[:-1] for m in marks], axis=0)))


def roots_of(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest row that each of n rows is connected with by the links."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[x], root[y])
        after = root.copy()
        np.minimum.at(after, x, low)
        np.minimum.at(after, y, low)
        np.minimum.at(after, root[x], low)
        np.minimum.at(after, root[y], low)
        after = after[after]
        if (after == root).all():
            return root
        root = after


def similar_embeddings(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", cfg: Quantisation = Quantisation()) -> DataFrame:
    """Rows (key as long, n_links, component_id, kept), one for each key: how many other keys have a vector with a cosine
    of cfg.cosine or more, the smallest key reachable over such links, and whether that is the key itself.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing: no links, their own key as component, kept.
    So do vectors of another dimension than the commonest. Vectors of any length are compared by direction only. A repeated
    key counts once, with the smallest of its usable vectors in the order of arrays. Rows with a null key give one row with a
    null key, no links, no component, kept. Other columns are left out. An empty table gives no rows.
    Equal vectors are linked and counted by their number. Pairs found are exact; pairs near the least cosine may be missed with probability cfg.miss.
    """
    spark, folder = rows.sparkSession, shared_dir(rows.sparkSession)
    zero = lambda v: F.transform(v, lambda x: x + F.lit(0.0))  # noqa: E731  minus zero is zero
    given = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    size = commonest_size(given.filter(usable("v")), "v")
    usable_v = F.when(usable("v") & (F.size("v") == size), zero("v"))
    data = written(given.groupBy("id").agg(F.min(usable_v).alias("v")), folder, "data")

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = [blake2b(v.tobytes(), digest_size=16).digest() for v in dense(batch.column("v"))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(digests, pa.binary())], names=["id", "v", "digest"])

    marked = data.filter("v is not null and id is not null").mapInArrow(digested, "id long, v array<double>, digest binary")
    classes = marked.groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("node"), "digest", "rep", "copies", "v"), folder, "classes")
    n = classes.count()
    if not n:
        out = data.select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
        return out
    picked = bounded_sample(classes.select(F.col("rep").alias("id"), "v"), n, min(cfg.sample, max(64, cfg.sample_bytes // (8 * size))))
    codes = learnt_codes(dense(picked["v"].combine_chunks()), n, cfg)
    sent = spark.sparkContext.broadcast(codes)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                v = dense(part.column("v"))
                units = v / np.linalg.norm(v, axis=1, keepdims=True)
                bits = sent.value.bits(units)
                strings = sent.value.substrings(bits).astype(np.int32)
                words = checked_words(bits).view(np.int64)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(strings.ravel()), strings.shape[1]).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("node"), part.column("copies"), part.column("v"), pa.array(sent.value.balls(units)), lists, pa.array(words[:, 0]), pa.array(words[:, 1])], names=["node", "copies", "v", "ball", "strings", "w0", "w1"])

    nodes = written(classes.select("node", "copies", "v").mapInArrow(coded, "node long, copies long, v array<double>, ball int, strings array<int>, w0 long, w1 long"), folder, "nodes")
    entries = nodes.select("node", "ball", "w0", "w1", F.posexplode("strings").alias("t", "string"))
    entries = entries.select("node", "ball", "w0", "w1", "t", (F.shiftleft(F.col("t").cast("long"), 32) + F.col("string")).alias("bucket"))

    # blocks of the buckets that are too large for one: the members of the largest ball in the bucket (major) never meet each other
    counted = entries.groupBy("bucket", "ball").count().groupBy("bucket").agg(F.sum("count").alias("members"), F.max(F.when(F.col("ball") >= 0, F.struct("count", "ball"))).alias("top"))
    need = lambda c: F.ceil(c / cfg.block).cast("int")
    top = F.coalesce("top.count", F.lit(0))
    large = counted.filter(F.col("members") > cfg.block).select("bucket", F.coalesce("top.ball", F.lit(-2)).alias("major"), need(top).alias("majors"), need(F.col("members") - top).alias("minors"))
    large = written(large, folder, "large")
    salted = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(cfg.salts - 1))))
    placed = entries.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(cfg.salts)).cast("int")).join(salted, ["bucket", "salt"], "left")
    is_major = F.coalesce(F.col("ball") == F.col("major"), F.lit(False))
    block = F.pmod(F.xxhash64("node", F.lit(1)), F.greatest(F.when(is_major, F.col("majors")).otherwise(F.coalesce("minors", F.lit(1))), F.lit(1))).cast("int")
    placed = placed.withColumn("own", F.when(is_major, -1 - block).otherwise(block))
    others = F.when(F.col("minors").isNull(), F.array(F.lit(0))).otherwise(F.filter(F.sequence(-F.col("majors"), F.col("minors") - 1), lambda o: (F.col("own") >= 0) | (o >= 0)))
    met = placed.withColumn("other", F.explode(others)).select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "ball", "t", "w0", "w1")
    unit = ("bucket", "i", "j")

    def candidates(part: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        words = np.stack([part["w0"].to_numpy(), part["w1"].to_numpy()], axis=1).view(np.uint64)
        two = part["i"].to_numpy() != part["j"].to_numpy()
        return partners(_unit_numbers(part), two, part["own"].to_numpy(), part["ball"].to_numpy(), part["t"].to_numpy(), words, sent.value)

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _whole_units(batches):
            wanted = np.zeros(part.num_rows, bool)
            for x, y in candidates(part):
                wanted[x] = wanted[y] = True
            if wanted.any():
                yield from part.filter(pa.array(wanted)).combine_chunks().to_batches()

    # one block by itself has i = j; a major block meets minor ones only
    likely = written(met.repartition(*unit).sortWithinPartitions(*unit).mapInArrow(possible, met.schema), folder, "likely")
    vectors = nodes.select("node", "copies", "v", "strings")

    def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _whole_units(batches):
            v, strings = dense(part["v"].combine_chunks()), dense(part["strings"].combine_chunks())
            norm, node, ball, copies = np.linalg.norm(v, axis=1), part["node"].to_numpy(), part["ball"].to_numpy(), part["copies"].to_numpy()
            table, step, linked = part["t"].to_numpy(), max(1, (4 << 20) // size), [(np.zeros(0, np.int64),) * 2]
            for x, y in candidates(part):
                for a in range(0, len(x), step):
                    p, q = x[a : a + step], y[a : a + step]
                    first = (strings[p] == strings[q]).argmax(axis=1) == table[p]
                    good = first & ((v[p] * v[q]).sum(axis=1) >= cfg.cosine * norm[p] * norm[q])
                    linked.append((p[good], q[good]))
            x, y = (np.concatenate(side) for side in zip(*linked, strict=True))
            links = np.bincount(x, copies[y], len(node)) + np.bincount(y, copies[x], len(node))
            group = np.where(ball >= 0, -1 - ball.astype(np.int64), node)
            some = np.flatnonzero(links)
            root = roots_of(len(node), x, y)
            yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(links[some].astype(np.int64)), pa.array(group[some]), pa.array(group[root[some]])], names=["node", "links", "a", "b"])

    rejoined = likely.join(grows(vectors), "node").repartition(*unit).sortWithinPartitions(*unit)
    found = written(rejoined.mapInArrow(confirmed, "node long, links long, a long, b long"), folder, "found")

    # a ball is one vertex of the graph; there are at most cfg.sample / cfg.heavy balls
    groups = connected_components(found.filter("a <> b").select("a", "b"), f"{folder}/graph")
    group = F.when(F.col("ball") >= 0, -1 - F.col("ball").cast("long")).otherwise(F.col("node")).alias("group")
    grouped = nodes.select("node", "copies", "ball", group).join(grows(classes.select("node", "rep", "digest")), "node")
    grouped = written(grouped, folder, "grouped")
    least = grouped.groupBy("group").agg(F.min("rep").alias("rep"))
    labelled = least.join(grows(groups.select(F.col("node").alias("group"), "component")), "group", "left").withColumn("component", F.coalesce("component", "group"))
    smallest = labelled.groupBy("component").agg(F.min("rep").alias("smallest"))
    named = written(labelled.join(grows(smallest), "component").select("group", "smallest"), folder, "named")
    weights = F.broadcast(grouped.filter("ball >= 0").groupBy("ball").agg(F.sum("copies").alias("weight")))
    in_ball = grouped.filter("ball >= 0").join(weights, "ball").join(F.broadcast(named.filter("group < 0")), "group").select("node", "digest", "copies", "weight", "smallest")
    alone = grouped.filter("ball < 0").withColumn("weight", F.col("copies")).join(grows(named.filter("group >= 0")), "group").select("node", "digest", "copies", "weight", "smallest")
    sums = found.groupBy("node").agg(F.sum("links").alias("links"))
    result = in_ball.unionByName(alone).join(grows(sums), "node", "left")
    result = written(result.select("digest", "copies", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "smallest"), folder, "result")

    # back to keys: classes of many copies by broadcast (1 / cfg.hot rows at most), the others by sorting
    total = classes.agg(F.sum("copies")).first()[0]
    hot = F.broadcast(result.filter(F.col("copies") > max(1.0, cfg.hot * total)).select("digest", F.col("n_links").alias("hot_links"), F.col("smallest").alias("hot_smallest")))
    ids = written(marked.select("id", "digest").join(hot, "digest", "left"), folder, "ids")
    cold = ids.filter("hot_links is null").select("id", "digest").join(grows(result.select("digest", "n_links", "smallest")), "digest").select("id", "n_links", "smallest")
    linked = ids.filter("hot_links is not null").select("id", F.col("hot_links").alias("n_links"), F.col("hot_smallest").alias("smallest")).unionByName(cold)
    rest = data.filter("v is null or id is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("smallest"))
    out = linked.unionByName(rest)
    for name in ("large", "nodes", "likely", "found", "graph", "grouped", "named", "classes"):
        removed(spark, f"{folder}/{name}")
    return out.select(F.col("id").alias(key), "n_links", F.col("smallest").alias("component_id"), F.coalesce(F.col("id") == F.col("smallest"), F.lit(True)).alias("kept"))
