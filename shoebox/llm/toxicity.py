"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the average of the vectors of its character n-grams (so misspellings and inflections share
vectors), a window is the average of its words, and a linear softmax scores the window. A text is as
toxic as its worst window; vectors and softmax are trained together through that (softened) maximum,
since labels say that a text is toxic, not where.

The softmax of two classes over averages is linear, so an executor needs one number per n-gram: its
vector's part in the difference of the two logits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM_WORD, BYTE_KEYS, STEP, mixed, run_hashes, shared_dir, spans_of, text_slices, utf8, written


@dataclass(frozen=True)
class ToxicityConfig:
    """max_rows bounds the labelled rows of each class that training takes (those with the smallest hash), max_bytes
    how many characters of a longer text it learns from; it is the only sample here, and every text is scored whole. part: about so many words,
    and n-grams, are in training's temporary arrays at once."""

    max_rows: int = 1500
    max_bytes: int = 1 << 15
    buckets: int = 1 << 18
    size: int = 8
    grams: tuple[int, ...] = (3, 4, 5, 6)
    window: int = 3
    rounds: int = 80
    rate: float = 0.05
    decay: float = 2e-6
    part: int = 1 << 17
    seed: int = 5


@dataclass
class ToxicityModel:
    """parts: the n-grams' numbers; bias: the logit of a text without words."""

    config: ToxicityConfig
    parts: np.ndarray
    bias: float

    def scores(self, column: pa.Array) -> np.ndarray:
        which, ids, rows, border = _words(column, self.config)
        logit = np.bincount(rows, self.parts[ids], int(which.max()) + 1 if len(which) else 0) / np.maximum(np.bincount(rows, minlength=int(which.max()) + 1 if len(which) else 0), 1)
        window, _, _ = _windows(logit[which] if len(which) else np.zeros(0), border, self.config.window)
        out = np.full(len(border) - 1, 0.0)
        full = np.flatnonzero(border[1:] > border[:-1])
        if len(full):
            out[full] = np.maximum.reduceat(window, border[full])
        return 1 / (1 + np.exp(-np.clip(out + self.bias, -40, 40)))


def _words(column: pa.Array, cfg: ToxicityConfig):
    """For each word of the texts its distinct word; n-gram numbers and the distinct word of each; borders of
    the texts, counted in words."""
    data, offsets = utf8(pc.utf8_lower(column))
    starts, ends = spans_of(ALNUM_WORD[data], offsets)
    border = np.searchsorted(starts, offsets)
    keys, first, which = np.unique(run_hashes(data, starts, ends), return_index=True, return_inverse=True)
    ids, rows = [], []
    for at in range(0, len(keys), 50_000):  # bounds the temporary arrays
        part = slice(at, at + 50_000)
        for x, row in _grams(data, starts[first[part]], ends[first[part]], keys[part], cfg):
            ids.append(x.astype(np.int32))
            rows.append((row + at).astype(np.int32))
    none = [np.zeros(0, np.int32)]
    return which, np.concatenate(ids or none), np.concatenate(rows or none), border


def _grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray, cfg: ToxicityConfig) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers, word of each) of whole words, and of the n-grams of "<word>" for each n."""
    lengths = ends - starts + 2
    cuts = np.cumsum(lengths)
    padded = np.full(int(lengths.sum()), 60, np.uint8)
    inner = np.arange(int((lengths - 2).sum())) + np.repeat(1 + 2 * np.arange(len(starts)), lengths - 2)
    padded[inner] = data[np.arange(len(inner)) + np.repeat(starts - (np.cumsum(lengths - 2) - (lengths - 2)), lengths - 2)]
    padded[cuts - 1] = 62
    row, until = np.repeat(np.arange(len(starts)), lengths), np.repeat(cuts, lengths)
    yield mixed(keys) % np.uint64(cfg.buckets), np.arange(len(starts))
    value, power = BYTE_KEYS[padded], np.ones(1, np.uint64)
    code = value.copy()
    for n in range(2, max(cfg.grams) + 1):
        power = power * STEP
        code = code[:-1] + value[n - 1 :] * power
        if n in cfg.grams:
            at = np.flatnonzero(np.arange(len(code)) + n <= until[: len(code)])
            yield mixed(code[at] + np.uint64(n)) % np.uint64(cfg.buckets), row[at]


def _windows(logit: np.ndarray, border: np.ndarray, w: int):
    """The mean logit of the w words from each word on, within its text, and that window's end and length."""
    at = np.arange(len(logit))
    end = np.minimum(at + w, np.repeat(border[1:], np.diff(border)))
    total = np.concatenate([[0.0], np.cumsum(logit)])
    return (total[end] - total[at]) / np.maximum(end - at, 1), end, end - at


def train(texts: list[str], toxic: list[int], cfg: ToxicityConfig = ToxicityConfig()) -> ToxicityModel:
    """Vectors and softmax by Adam over all given texts, classes weighted alike."""
    label = np.array(toxic, float)
    if not len(label) or label.min() == label.max():  # nothing to learn from: every text gets the one label known, or 0
        sure = 3.0 if len(label) and label.min() else -3.0
        return ToxicityModel(cfg, np.zeros(cfg.buckets, np.float32), sure)
    which, ids, rows, border = _words(pa.array(texts, pa.string()), cfg)
    which = which.astype(np.int32)
    rng, words = np.random.default_rng(cfg.seed), int(which.max(initial=-1)) + 1
    count = np.bincount(rows, minlength=words)
    vectors = rng.normal(0, 0.1, (cfg.buckets, cfg.size)).astype(np.float32)
    used = np.unique(ids)
    softmax, bias = rng.normal(0, 1, (2, cfg.size)), np.zeros(1)
    weight = np.where(label == 1, 0.5 / label.sum(), 0.5 / (len(label) - label.sum()))
    slices = [slice(at, at + cfg.part) for at in range(0, len(ids), cfg.part)]
    groups = np.unique(np.append(np.searchsorted(border, np.arange(0, border[-1], cfg.part)), len(label)))
    state: dict = {}

    def adam(name, value, slope, t, at=slice(None)):
        m, v = state.setdefault(name, (np.zeros_like(value[at]), np.zeros_like(value[at])))
        m += 0.1 * (slope - m)
        np.square(slope, out=slope)
        v += 0.01 * (slope - v)
        step = np.sqrt(v / (1 - 0.99**t))
        step += 1e-9
        np.divide(m, step, out=step)
        step *= cfg.rate / (1 - 0.9**t)
        value[at] -= step

    def summed(to: np.ndarray, what: np.ndarray, of: np.ndarray, size: int) -> np.ndarray:
        """Sums of what[of] by to, a slice at a time."""
        return sum((np.bincount(to[part], what[of[part]], size) for part in slices), np.zeros(size))

    for t in range(1, cfg.rounds + 1):
        done = min(1.0, t / (0.6 * cfg.rounds))
        sharp = 0.5 + 3.5 * done  # from nearly a mean to nearly the maximum
        difference = softmax[1] - softmax[0]
        logit = summed(rows, vectors @ difference, ids, words) / count
        d_word, d_bias = np.zeros(words), 0.0
        for a, b in zip(groups[:-1], groups[1:], strict=True):  # some texts at once
            here, inside = which[border[a] : border[b]], border[a : b + 1] - border[a]
            long = np.diff(inside)
            full, text_of = np.flatnonzero(long), np.repeat(np.arange(b - a), long)
            window, end, length = _windows(logit[here], inside, cfg.window)
            top = np.zeros(b - a)
            if len(full):
                top[full] = np.maximum.reduceat(window, inside[full])
            e = np.exp(sharp * (window - top[text_of]))
            mass = np.bincount(text_of, e, b - a)
            score = top + np.log(np.maximum(mass, 1) / np.maximum(long, 1)) / sharp * (1 - done)
            error = (1 / (1 + np.exp(-np.clip(score + bias[0], -40, 40))) - label[a:b]) * weight[a:b]
            d_window = error[text_of] * e / np.maximum(mass, 1e-300)[text_of] / length
            turn = np.bincount(np.arange(len(window)), d_window, len(window) + 1) - np.bincount(end, d_window, len(window) + 1)
            d_word += np.bincount(here, np.cumsum(turn)[:-1], words)
            d_bias += error.sum()
        d_part = summed(ids, d_word / count, rows, cfg.buckets)
        slope = np.outer(d_part[used].astype(np.float32), difference.astype(np.float32))
        slope += np.float32(cfg.decay) * vectors[used]
        adam("v", vectors, slope, t, used)
        pull = vectors.T @ d_part
        adam("s", softmax, np.stack([-pull, pull]) + cfg.decay * softmax, t)
        adam("b", bias, np.array([d_bias]), t)
    return ToxicityModel(cfg, (vectors @ (softmax[1] - softmax[0])).astype(np.float32), float(bias[0]))


def training_rows(docs: DataFrame, labels: DataFrame, may_learn, text: str, key: str, cfg: ToxicityConfig) -> list:
    """At most max_rows labelled texts of each class, with their label: of the labelled keys that have a text, those with the
    smallest hash, from below a limit that is set by the class's count, so little more than is taken leaves the tasks. The side that is
    broadcast has a fixed bound; copies of a key are put together (the smallest text stays), and a longer text is cut to max_bytes
    characters, before anything reaches the driver."""
    known = labels.filter(may_learn & F.col(key).isNotNull() & F.col("toxic").isin(0, 1)).groupBy(key).agg(F.max("toxic").alias("toxic"))
    known = known.join(docs.filter(F.col(text).isNotNull()).select(key).hint("merge"), key, "left_semi")
    known = written(known, shared_dir(docs.sparkSession), "labelled")
    size = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    place = F.pmod(F.xxhash64(key), F.lit(1 << 30))
    near = lambda y: min(1.0, (1.5 * cfg.max_rows + 20) / size.get(y, 1)) * (1 << 30)
    chosen = [known.filter((F.col("toxic") == y) & (place < near(y))).orderBy(place, key).limit(cfg.max_rows) for y in (0, 1)]
    sample = F.broadcast(chosen[0].union(chosen[1]))
    texts = docs.select(key, text).filter(F.col(text).isNotNull()).join(sample, key)
    return texts.groupBy(key).agg(F.substring(F.min(text), 1, cfg.max_bytes).alias(text), F.first("toxic").alias("toxic")).orderBy(key).collect()


def score_toxicity(docs: DataFrame, labels: DataFrame, may_learn, text: str = "text", key: str = "doc_id", cfg: ToxicityConfig = ToxicityConfig(), keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (key, keep..., score) for each row: the probability that the whole text is toxic, after
    training on the rows of labels (key, toxic) for which the column expression may_learn over key holds.

    A text without words (null, empty, blank) gets the model's bias. Rows without a label in 0, 1 aren't
    learnt from; a key with several labels counts as toxic if any says so; a repeated key is learnt from
    once, by the smallest of its texts. Repeated rows each give a row; a null key is kept; an empty table gives no rows. Without labels of both classes the score is constant. Other columns are left out.
    """
    model = train(*zip(*[(r[text], r["toxic"]) for r in rows], strict=True), cfg) if (rows := training_rows(docs, labels, may_learn, text, key, cfg)) else train([], [], cfg)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    fields = [docs.schema[c] for c in dict.fromkeys([key, *keep])]
    schema = T.StructType([*fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, text):
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in fields), pa.array(sent.value.scores(part.column(text)))], names=schema.names)

    return docs.select(*dict.fromkeys([key, *keep, text])).mapInArrow(run, schema)
