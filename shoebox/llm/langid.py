"""Language identification: a linear-chain conditional random field labels every word of a text.

Features of a word are its affixes, its character n-grams, and whether and in which languages a lexicon
counted on the training rows lists it. Transitions are learned from training sequences that switch
languages, put together from pieces of the training texts, so code-switched text is followed word by
word. A text's language is the label with the largest sum of marginals by forward-backward.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import crf
from .common import BYTE_KEYS, byte_class, mixed, run_hashes, spans_of, text_slices, utf8
from .pii import sequence_borders

LETTERS = byte_class(lambda i: i >= 128 or chr(i).isalpha())
BUCKETS = 1 << 16


@dataclass(frozen=True)
class LanguageConfig:
    """rows bounds the training texts of each language (those with the smallest hash), total those of all languages
    together (many languages get fewer rows each, but one at least), max_bytes how many characters of a longer text are learnt
    from; pieces and piece what is taken of each; lexicon is the number of frequent words listed for each
    language. It is the only sample here: every language is learnt, and every text is labelled whole.
    longest: a longer line is cut into sequences of so many words."""

    rows: int = 150
    total: int = 12_000
    max_bytes: int = 1 << 15
    pieces: int = 4
    piece: int = 25
    lexicon: int = 400
    rounds: int = 30
    longest: int = 256
    seed: int = 17


@dataclass
class LanguageModel:
    config: LanguageConfig
    field: crf.Crf
    lexicon: np.ndarray  # sorted word hashes, with the languages that list each as a number
    listed: np.ndarray

    def features(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> crf.Features:
        return word_features(data, starts, ends, self.lexicon, self.listed)


def language_set(numbers: list[int]) -> int:
    """A number of 62 bits for a set of languages, however many there are."""
    return int.from_bytes(hashlib.blake2b(",".join(map(str, sorted(numbers))).encode(), digest_size=8).digest(), "big") >> 2


def word_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lexicon: np.ndarray, listed: np.ndarray) -> crf.Features:
    """Affixes of one to four bytes and the lexicon entry as one part, bigrams and trigrams as others."""
    own = run_hashes(data, starts, ends)
    at = np.minimum(np.searchsorted(lexicon, own), max(len(lexicon) - 1, 0))
    entry = np.where(lexicon[at] == own, listed[at] + 1, 0).astype(np.uint64) if len(lexicon) else np.zeros(len(own), np.uint64)
    columns = [entry, *(run_hashes(data, starts, np.minimum(ends, starts + n)) for n in (1, 2, 3, 4)), *(run_hashes(data, np.maximum(starts, ends - n), ends) for n in (1, 2, 3, 4))]
    fixed = np.stack([mixed(c + np.uint64(1_000_003 * i)) % np.uint64(BUCKETS) for i, c in enumerate(columns)], axis=1).astype(np.int64)
    parts = [(fixed.ravel(), np.arange(len(starts) + 1) * fixed.shape[1])]
    value = BYTE_KEYS[data]
    for n in (2, 3):
        count = np.maximum(ends - starts - n + 1, 0)
        border = np.concatenate([[0], np.cumsum(count)])
        place = np.repeat(starts - border[:-1], count) + np.arange(int(border[-1]))
        code = value[place] if len(place) else np.zeros(0, np.uint64)
        for j in range(1, n):
            code = code * np.uint64(0x100000001B3) + value[place + j]
        parts.append(((mixed(code + np.uint64(n)) % np.uint64(BUCKETS)).astype(np.int64), border))
    return parts


def _lower_words(text: str) -> list[bytes]:
    data, offsets = utf8(pc.utf8_lower(pa.array([text])))
    starts, ends = spans_of(LETTERS[data], offsets)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(starts, ends, strict=True)]


def train(rows: list[tuple[str, str]], cfg: LanguageConfig = LanguageConfig()) -> LanguageModel | None:
    """rows: (text, language). None if no row has a letter."""
    by_language: dict[str, list[list[bytes]]] = {}
    for text, lang in rows:
        if words := _lower_words(text):
            by_language.setdefault(lang, []).append(words)
    if not by_language:
        return None
    labels, rng = sorted(by_language), np.random.default_rng(cfg.seed)
    listing: dict[bytes, list[int]] = defaultdict(list)
    for i, lang in enumerate(labels):
        common = Counter(w for words in by_language[lang] for w in words)
        for w, _ in sorted(common.items(), key=lambda x: (-x[1], x[0]))[: cfg.lexicon]:
            listing[w].append(i)
    names = sorted(listing)
    ends = np.cumsum([len(w) for w in names])
    hashes = run_hashes(np.frombuffer(b"".join(names), np.uint8), ends - [len(w) for w in names], ends)
    order = np.argsort(hashes)
    lexicon, listed = hashes[order], np.array([language_set(listing[w]) for w in names], np.uint64)[order]
    pieces = []
    for lang in labels:
        for words in by_language[lang]:
            for at in rng.integers(0, max(1, len(words) - cfg.piece + 1), cfg.pieces):
                pieces.append((words[at : at + cfg.piece], lang))
    sequences = []
    shuffled = rng.permutation(len(pieces))
    for a, b in zip(shuffled[::2], np.append(shuffled[1::2], shuffled[:1]), strict=False):  # two pieces make a sequence
        (x, lx), (y, ly) = pieces[a], pieces[b]
        sequences.append((x + y, [lx] * len(x) + [ly] * len(y)))

    def features(words: list[bytes]) -> crf.Features:
        stop = np.cumsum([len(w) for w in words])
        return word_features(np.frombuffer(b"".join(words), np.uint8), stop - [len(w) for w in words], stop, lexicon, listed)

    return LanguageModel(cfg, crf.train(labels, features, sequences, BUCKETS, rounds=cfg.rounds, decay=3e-4), lexicon, listed)


def label_words(model: LanguageModel, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in bytes of the lowered texts, borders of the texts in words, and each word's marginals."""
    data, offsets = utf8(pc.utf8_lower(column))
    starts, ends = spans_of(LETTERS[data], offsets)
    if not len(starts):
        return starts, ends, np.zeros(len(column) + 1, np.int64), np.zeros((0, len(model.field.labels)))
    keys, first, which = np.unique(run_hashes(data, starts, ends), return_index=True, return_inverse=True)
    border = sequence_borders(data, starts, offsets, model.config.longest)
    scores = model.field.place_scores(model.features(data, starts[first], ends[first]), len(keys), which, border)
    chance = crf.marginals(scores, model.field.transitions, border)
    return starts, ends, np.searchsorted(starts, offsets), chance


def training_rows(docs: DataFrame, may_learn: Column, text: str, lang: str, key: str, cfg: LanguageConfig) -> list[tuple[str, str]]:
    """At most cfg.rows texts of each language: one pass counts distinct texts, one takes those whose hash lies below a limit
    for about 1.5 times as many, of which the smallest stay. Copies of a text under one key count once in both, so neither a
    hot row nor long texts (which are cut to cfg.max_bytes characters) cost a language its place; only languages, and a bounded number of
    bounded texts, reach the driver."""
    known = docs.filter(may_learn & F.col(lang).isNotNull() & F.col(text).isNotNull())
    place = F.pmod(F.xxhash64(key, text), F.lit(1 << 30))
    common = known.select(F.col(lang).alias("lang"), place.alias("place")).distinct().groupBy("lang").count().orderBy("lang").collect()
    if not common:
        return []
    each = max(1, min(cfg.rows, cfg.total // len(common)))
    limit = F.element_at(F.create_map(*(F.lit(x) for r in common for x in (r["lang"], min(1.0, (1.5 * each + 20) / r["count"])))), F.col(lang))
    near = known.filter(place < limit * (1 << 30)).groupBy(F.col(lang).alias("lang"), place.alias("place")).agg(F.min(F.substring(text, 1, cfg.max_bytes)).alias("text"))
    mine: dict[str, list] = defaultdict(list)
    for r in sorted(near.collect(), key=lambda r: (r["lang"], r["place"])):
        mine[r["lang"]].append((r["text"], r["lang"]))
    return [x for name in sorted(mine) for x in mine[name][:each]]


def identify_languages(docs: DataFrame, may_learn: Column, text: str = "text", lang: str = "lang", key: str = "doc_id", cfg: LanguageConfig = LanguageConfig()) -> DataFrame:
    """Rows (key, lang_pred, score, word_langs map<string, long>) for each row: the language of the whole text, its
    mean marginal over the words, and how many words are labelled with each language.

    Learns from text and lang of the rows for which may_learn, an expression over key, holds, every language that
    they name. A text that is null or has no letter, and every text if nothing could be learnt, is `und` with
    score 0. Ties go to the first language by name. Repeated rows each give a row (and are learnt from once); a
    null key is kept; other columns are left out. An empty table gives no rows.
    """
    model = train(training_rows(docs, may_learn, text, lang, key, cfg), cfg)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([docs.schema[key], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("word_langs", T.MapType(T.StringType(), T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for part in text_slices(batch, text):
                names, scores, words = ["und"] * part.num_rows, np.zeros(part.num_rows), [{} for _ in range(part.num_rows)]
                if own is not None:
                    labels = own.field.labels
                    _, _, border, chance = label_words(own, part.column(text))
                    count = np.diff(border)
                    total = np.diff(np.concatenate([np.zeros((1, len(labels))), np.cumsum(chance, axis=0)])[border], axis=0)
                    best = chance.argmax(axis=1) if len(chance) else np.zeros(0, np.int64)
                    tally = np.bincount(np.repeat(np.arange(part.num_rows), count) * len(labels) + best, minlength=part.num_rows * len(labels)).reshape(-1, len(labels))
                    for i in np.flatnonzero(count):
                        value = part.column(text)[int(i)].as_py()
                        if value.isascii() or any(c.isalpha() for c in value):
                            top = int(total[i].argmax())
                            names[i], scores[i] = labels[top], min(1.0, max(0.0, total[i, top] / count[i]))
                            words[i] = {labels[k]: int(tally[i, k]) for k in np.flatnonzero(tally[i])}
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(names), pa.array(scores), pa.array([list(w.items()) for w in words], pa.map_(pa.string(), pa.int64()))], names=schema.names)

    return docs.select(key, text).mapInArrow(run, schema)
