"""Approximate nearest neighbours by collision counting over single projections.

The measure is the inner product: each vector is scaled and extended by one coordinate so that all have
the length of the longest, which turns the largest inner product into the smallest distance.

1. Centres drawn from a bounded sample cut the vectors into cells; a cell's reach is the largest distance of its
   vectors from the centre. A large cell is dealt to blocks of bounded size.
2. The k-th distance of a query among the sample bounds its k-th distance among all, so only cells whose reach
   comes within that bound are visited; no neighbour is lost by it.
3. In a block every vector has m random projections, kept as m sorted arrays. A query opens a window around its
   own projected value in each (two binary searches give it as ranks) and counts in how many windows each vector
   falls. Vectors over the collision threshold are verified with the exact measure. Windows start narrow and
   widen by virtual rehashing (the same arrays, a larger radius) until the query has k verified neighbours
   within the radius, or its own last radius, estimated from its distances to the sample, was searched.
   Narrow windows are counted entry by entry, so only rows inside them are touched; wide ones, which hold a large
   part of the block anyway, wait for the last radius and are counted by comparing ranks.
4. Only neighbours within a query's last radius leave a block, some k of them over all blocks however many there are.
   Queries that then have fewer than k visit the same cells once more, and there every vector is verified, up to
   the bound of their k-th distance. So a query has k rows, or as many as there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, erf, floor, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import bounded_sample, commonest_size, dense, removed, shared_dir, usable, written
from .neardup import grows


@dataclass(frozen=True)
class CollisionConfig:
    """steps are the radii searched, as shares of a query's last radius, which is the distance of its k-th neighbour
    as the sample tells it, times margin. A window of a radius reaches width * radius to both sides. slack: how
    many standard deviations fewer windows than expected at the radius a neighbour may share. sample: vectors,
    and of sample_bytes at most, the only sample here, that centres and radii come from (every vector is indexed). block, query_block: about so many
    vectors, and queries, meet in a task at once. sparse: windows that hold a smaller share are counted entry by entry."""

    projections: int = 96
    width: float = 0.9
    steps: tuple[float, ...] = (0.25, 0.5, 1.0)
    margin: float = 1.0
    slack: float = 1.8
    sample: int = 8192
    sample_bytes: int = 16 << 20
    cells: int = 512
    block: int = 4096
    query_block: int = 2048
    sparse: float = 0.04
    seed: int = 3

    @property
    def threshold(self) -> int:
        """Windows that a vector at the radius shares, but for slack: each holds it if |Z| < width for a normal Z."""
        m, p = self.projections, erf(self.width / sqrt(2))
        return max(1, floor(m * p - self.slack * sqrt(m * p * (1 - p))))


def extended(vectors: np.ndarray, longest: float) -> np.ndarray:
    """The vectors over the longest length, with the coordinate that makes each a unit vector."""
    unit = vectors / longest
    return np.hstack([unit, np.sqrt(np.maximum(0, 1 - (unit**2).sum(axis=1, keepdims=True)))])


def asked(queries: np.ndarray) -> np.ndarray:
    """The queries as unit vectors of the extended space."""
    return np.hstack([queries / np.linalg.norm(queries, axis=1, keepdims=True), np.zeros((len(queries), 1))])


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of unit vectors."""
    return np.sqrt(np.maximum(0, 2 - 2 * (x @ y.T)))


class SortedProjections:
    """The sorted projection arrays of one block; longest is the length of the longest vector of the whole table."""

    def __init__(self, vectors: np.ndarray, longest: float, cfg: CollisionConfig):
        self.vectors, self.cfg = vectors, cfg
        self.axes = np.random.default_rng(cfg.seed).normal(size=(vectors.shape[1] + 1, cfg.projections))
        values = (extended(vectors, longest) @ self.axes).T
        self.order = np.argsort(values, axis=1, kind="stable")
        self.sorted = np.take_along_axis(values, self.order, axis=1)
        self.ranks = np.argsort(self.order, axis=1).astype(np.uint32 if len(vectors) > 65000 else np.uint16)

    def collisions(self, queries: np.ndarray, radius: np.ndarray, narrow: bool = False) -> np.ndarray:
        """In how many of the windows around each (unit) query's projections each vector lies. narrow: wide windows are left for a later radius."""
        at, reach, n = queries @ self.axes, self.cfg.width * radius, len(self.vectors)
        low = np.stack([np.searchsorted(v, x - reach) for v, x in zip(self.sorted, at.T, strict=True)])
        size = np.stack([np.searchsorted(v, x + reach, side="right") for v, x in zip(self.sorted, at.T, strict=True)]) - low
        count = np.zeros((len(queries), n), np.uint8 if self.cfg.projections < 256 else np.uint16)
        few = size.sum(axis=0) < self.cfg.sparse * n * self.cfg.projections
        for q in np.flatnonzero(few):  # touches the entries of its windows only
            entries = np.concatenate([o[a : a + s] for o, a, s in zip(self.order, low[:, q], size[:, q], strict=True)])
            count[q] = np.bincount(entries, minlength=n)
        many = np.flatnonzero(~few)
        if len(many) and not narrow:
            wide = np.zeros((len(many), n), count.dtype)
            for ranks, a, s in zip(self.ranks, low[:, many], size[:, many], strict=True):
                wide += (ranks[None, :] - a.astype(ranks.dtype)[:, None]) < s.astype(ranks.dtype)[:, None]  # wraps below the window
            whole = (size[:, many] == n).sum(axis=0)
            if n == np.iinfo(self.ranks.dtype).max + 1 and whole.any():
                wide += whole.astype(count.dtype)[:, None]  # n itself doesn't fit the type of the ranks
            count[many] = wide
        return count


def search(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, longest: float, last: np.ndarray, k: int, cfg: CollisionConfig) -> tuple[np.ndarray, np.ndarray]:
    """Each query's k best verified vectors of the block but itself, up to its last radius: scores and ids; -inf where there are fewer."""
    index, lengths, units = SortedProjections(vectors, longest, cfg), np.linalg.norm(queries, axis=1), asked(queries)
    best, best_ids = np.full((len(queries), k), -np.inf), np.full((len(queries), k), np.iinfo(np.int64).max)
    for at in range(0, len(queries), 128):
        active = np.arange(at, min(at + 128, len(queries)))
        seen = np.zeros((len(active), len(ids)), bool)
        for step in cfg.steps:
            radius = step * last[active]
            over = (index.collisions(units[active], radius, step < 1) >= cfg.threshold) & ~seen
            seen |= over
            q, v = np.nonzero(over & (ids[None, :] != query_ids[active, None]))
            for part in range(0, len(q), 65536):
                x, y = active[q[part : part + 65536]], v[part : part + 65536]
                _merge(best, best_ids, x, (vectors[y] * queries[x]).sum(axis=1), ids[y], k)
            going = best[active, k - 1] < longest * lengths[active] * (1 - radius**2 / 2)
            active, seen = active[going], seen[going]
            if not len(active):
                break
    best[best < (longest * lengths * (1 - last**2 / 2))[:, None]] = -np.inf  # what lies beyond the last radius is no result of this search
    return best, best_ids


def search_all(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, longest: float, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """What search gives, with every vector of the block looked at, up to the bound of each query's k-th distance. A matrix product, whose last bits depend on the
    place in it, picks the k best and those within rounding of them; these are scored as in search, so ties stay ties."""
    best, best_ids = np.full((len(queries), k), -np.inf), np.full((len(queries), k), np.iinfo(np.int64).max)
    rounding = 1e-9 * np.linalg.norm(vectors, axis=1).max() * np.linalg.norm(queries, axis=1)
    for at in range(0, len(queries), 128):
        rows = np.arange(at, min(at + 128, len(queries)))
        rough, other = queries[rows] @ vectors.T, ids[None, :] != query_ids[rows, None]
        if len(ids) > k:
            least = np.partition(np.where(other, rough, -np.inf), len(ids) - k, axis=1)[:, len(ids) - k]
            other &= rough >= (least - rounding[rows])[:, None]
        q, v = np.nonzero(other)
        for part in range(0, len(q), 65536):
            x, y = rows[q[part : part + 65536]], v[part : part + 65536]
            _merge(best, best_ids, x, (vectors[y] * queries[x]).sum(axis=1), ids[y], k)
    lengths = np.linalg.norm(queries, axis=1)
    best[best < (longest * lengths * (1 - (bound + 1e-6) ** 2 / 2))[:, None]] = -np.inf
    return best, best_ids


def query_radii(queries: np.ndarray, query_ids: np.ndarray, sample: np.ndarray, sample_ids: np.ndarray, n: int, k: int, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """For each (unit) query its last radius, at which the sample lets expect k neighbours among n vectors and two
    standard deviations more, and a bound that its k-th distance can't exceed (2 where the sample is too small)."""
    far = np.where(sample_ids[None, :] == query_ids[:, None], np.inf, distances(queries, sample))
    far.sort(axis=1)
    expect = k * len(sample) / max(n, 1)
    place = min(len(sample), ceil(expect + 2 * sqrt(expect)) + 1) - 1
    last = far[:, place] if len(sample) else np.full(len(queries), 2.0)
    bound = far[:, k - 1] if len(sample) >= k else np.full(len(queries), 2.0)
    return np.minimum(2.0, margin * np.maximum(last, 0.1)), np.minimum(2.0, bound)


def _merge(best: np.ndarray, best_ids: np.ndarray, rows: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> None:
    keep = (score > best[rows, k - 1]) | ((score == best[rows, k - 1]) & (ids < best_ids[rows, k - 1]))
    rows, score, ids = rows[keep], score[keep], ids[keep]
    touched = np.unique(rows)
    rows = np.concatenate([rows, np.repeat(touched, k)])
    score, ids = np.concatenate([score, best[touched].ravel()]), np.concatenate([ids, best_ids[touched].ravel()])
    order = np.lexsort((ids, -score, rows))
    pick = order[np.searchsorted(rows[order], touched)[:, None] + np.arange(k)]
    best[touched], best_ids[touched] = score[pick], ids[pick]


def nearest_neighbours(rows: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 20, cfg: CollisionConfig = CollisionConfig()) -> DataFrame:
    """Rows (query_id, rank, key, score): for each row for which is_query holds, the k rows with the largest
    inner product found among all other rows, nearest first, ties to the smaller key.

    Vectors that are null, empty, zero, or hold null or non-finite components take no part; nor do null
    keys and vectors of another dimension than the commonest. A repeated key counts once, with the smallest of its
    vectors in the order of arrays. Other columns are left out. An empty table, or one without queries, gives no
    rows. Every query has k rows, or as many as there are other vectors.
    Blocks of a cell's vectors meet blocks of the queries that visit it, both of bounded size, so the work is spread
    over as many tasks as there are pairs of blocks. Where vectors form clusters, a query visits a few
    cells; where all lie alike far from each other, no index can spare visits, and all cells are visited.
    """
    folder = shared_dir(rows.sparkSession)
    good = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).filter(usable("v") & F.col("id").isNotNull())
    size = commonest_size(good, "v")
    alike = good.filter(F.size("v") == size).groupBy("id").agg(F.min(F.struct("v", "asks")).alias("best")).select("id", "best.v", "best.asks")
    data = written(alike, folder, "vectors")
    known = data.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("square")).first()
    n, longest = known["n"], sqrt(known["square"] or 1.0) * (1 + 1e-12)
    picked = bounded_sample(data.select("id", "v"), n, min(cfg.sample, max(256, cfg.sample_bytes // (8 * max(size, 1)))))
    sample, sample_ids = extended(dense(picked["v"].combine_chunks()) if picked.num_rows else np.zeros((0, size)), longest), picked["id"].to_numpy()
    centres = sample[: max(1, min(cfg.cells, len(sample) // 8, ceil(n / 1024)))]
    sent = rows.sparkSession.sparkContext.broadcast((sample, sample_ids, centres))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, middle = sent.value
        for batch in batches:
            far = distances(extended(dense(batch.column("v")), longest), middle) if batch.num_rows else np.zeros((0, 1))
            cell = far.argmin(axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far[np.arange(len(far)), cell])], names=[*batch.schema.names, "cell", "away"])

    celled = written(data.mapInArrow(placed, "id long, v array<double>, asks boolean, cell int, away double"), folder, "cells")
    about = {r["cell"]: (r["n"], r["reach"]) for r in celled.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("reach")).collect()}  # cfg.cells rows at most
    reach = np.array([about.get(c, (0, -4.0))[1] + 1e-9 for c in range(len(centres))])
    block_of = lambda salt, of: F.pmod(F.xxhash64("id", F.lit(salt)), of).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), of - 1))

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, near_ids, middle = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                units = asked(dense(part.column("v")))
                last, bound = query_radii(units, part.column("id").to_numpy(), near, near_ids, n, k, cfg.margin)
                visits = distances(units, middle) - reach <= bound[:, None] + 1e-6
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("v"), pa.array(last), pa.array(bound), pa.array([np.flatnonzero(x).astype(np.int32) for x in visits], pa.list_(pa.int32()))], names=["id", "v", "last", "bound", "visits"])

    asking = written(celled.filter("asks").select("id", "v").mapInArrow(routed, "id long, v array<double>, last double, bound double, visits array<int>"), folder, "asking")
    order = W.Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    blocks = F.element_at(F.array(*(F.lit(max(1, -(-about.get(c, (0, 0))[0] // cfg.block))) for c in range(len(centres)))), F.col("cell") + 1)

    def ranked(asking: DataFrame, exact: bool) -> DataFrame:
        visiting = asking.select("id", "v", "last", "bound", F.explode("visits").alias("cell"))
        crowd = {r["cell"]: r["count"] for r in visiting.groupBy("cell").count().collect()}
        query_blocks = F.element_at(F.array(*(F.lit(-(-crowd.get(c, 0) // cfg.query_block)) for c in range(len(centres)))), F.col("cell") + 1)
        left = celled.withColumn("many", query_blocks).filter("many > 0").select("id", "v", "cell", block_of(1, blocks).alias("block"), every(F.col("many")).alias("query_block"))
        right = visiting.select("id", "v", "last", "bound", "cell", block_of(2, query_blocks).alias("query_block"), every(blocks).alias("block"))

        def meet(vectors: pa.Table, queries: pa.Table) -> pa.Table:
            if not vectors.num_rows or not queries.num_rows:
                return pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
            who = queries["id"].to_numpy()
            block = dense(vectors["v"].combine_chunks()), vectors["id"].to_numpy(), dense(queries["v"].combine_chunks()), who
            best, ids = search_all(*block, longest, queries["bound"].to_numpy(), k) if exact else search(*block, longest, queries["last"].to_numpy(), k, cfg)
            found = np.isfinite(best)
            return pa.table({"query_id": np.repeat(who, k)[found.ravel()], "id": ids[found], "score": best[found]})

        keys = ("cell", "block", "query_block")
        pairs = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "query_id long, id long, score double")
        return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    first = written(ranked(asking, False), folder, "first")
    reached = first.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("found"), F.min("score").alias("least"))
    within = longest * (1 - F.col("last") ** 2 / 2) * F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    short = asking.join(grows(reached), "id", "left").filter((F.coalesce("found", F.lit(0)) < min(k, max(n - 1, 0))) | (F.col("least") < within))
    short = written(short.select("id", "v", "last", "bound", "visits"), folder, "short")
    if short.limit(1).count():
        done = first.join(grows(short.select(F.col("id").alias("query_id"))), "query_id", "left_anti")
        first = written(done.unionByName(ranked(short, True)), folder, "all")
    for name in ("vectors", "cells", "asking", "short"):
        removed(rows.sparkSession, f"{folder}/{name}")
    return first.select("query_id", "rank", F.col("id").alias(key), "score")
