"""A linear-chain conditional random field in numpy: training, Viterbi and forward-backward over batches.

A word's features are hashed numbers; a label's score at a place is the sum of the weights of the
features of the word there and, by separate weights, of its neighbours, plus the learned transition.
Feature sums are taken once for each distinct word of a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np

#: Features of distinct words: parts of (feature numbers, borders by word).
Features = list[tuple[np.ndarray, np.ndarray]]


@dataclass
class Crf:
    labels: list[str]
    buckets: int
    contexts: tuple[int, ...] = (0,)
    weights: dict[int, np.ndarray] = field(default_factory=dict)
    transitions: np.ndarray | None = None

    def word_scores(self, parts: Features, words: int, context: int = 0) -> np.ndarray:
        out = np.zeros((words, len(self.labels)), np.float32)
        for ids, border in parts:
            for at in range(0, words, 50_000):  # bounds the temporary array
                end = min(words, at + 50_000)
                out[at:end] += _segment_sums(self.weights[context][ids[border[at] : border[end]]], border[at : end + 1] - border[at])
        return out

    def place_scores(self, parts: Features, words: int, which: np.ndarray, border: np.ndarray) -> np.ndarray:
        """Scores at each place: which is the distinct word there, border cuts the sequences."""
        total = self.word_scores(parts, words)[which]
        for c in self.contexts:
            if c:
                at = _inside(border, len(which), c)
                total[at] += self.word_scores(parts, words, c)[which[at + c]]
        return total


def _inside(border: np.ndarray, n: int, c: int) -> np.ndarray:
    """The places whose c-th neighbour (before, if negative) belongs to the same sequence."""
    lengths = np.diff(border)
    since = np.arange(n) - np.repeat(border[:-1], lengths)
    return np.flatnonzero(since >= -c if c < 0 else since + c < np.repeat(lengths, lengths))


def _segment_sums(values: np.ndarray, border: np.ndarray) -> np.ndarray:
    out = np.zeros((len(border) - 1, values.shape[1]), np.float32)
    full = np.flatnonzero(border[1:] > border[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, border[full], axis=0)
    return out


def _steps(border: np.ndarray) -> Iterator[np.ndarray]:
    """For t = 0, 1, ...: the t-th place of each sequence that is long enough, longest sequences first."""
    lengths = np.diff(border)
    order = np.argsort(-lengths, kind="stable")
    down, first = -lengths[order], border[:-1][order]
    for t in range(int(-down[0]) if len(down) else 0):
        yield first[: int(np.searchsorted(down, -t, side="left"))] + t


def viterbi(scores: np.ndarray, transitions: np.ndarray, border: np.ndarray) -> np.ndarray:
    """The best label of each place."""
    n, k = scores.shape
    back = np.zeros((n, k), np.int16)
    best = np.zeros(n, np.int64)
    prev, ends, steps = None, [], list(_steps(border))
    for t, at in enumerate(steps):
        if t == 0:
            now = scores[at]
        else:
            ends.append(prev[len(at) :].argmax(axis=1))
            prev = prev[: len(at)]
            now, from_ = prev[:, :1] + transitions[0], np.zeros((len(at), k), np.int16)
            for j in range(1, k):
                other = prev[:, j : j + 1] + transitions[j]
                better = other > now
                np.copyto(now, other, where=better)
                from_[better] = j
            back[at] = from_
            now = now + scores[at]
        prev = now
    if prev is not None:
        ends.append(prev.argmax(axis=1))
    label = np.zeros(0, np.int64)
    for t in range(len(steps) - 1, -1, -1):
        at = steps[t]
        if len(label):
            label = back[steps[t + 1], label].astype(np.int64)
        label = np.concatenate([label, ends[t]])  # sequences that end here follow the longer ones
        best[at] = label
    return best


def marginals(scores: np.ndarray, transitions: np.ndarray, border: np.ndarray, moves: np.ndarray | None = None) -> np.ndarray:
    """Label probabilities at each place by forward-backward; the expected transition counts are added to moves, if given."""
    move = np.exp(transitions - transitions.max()).astype(np.float64)
    local = np.exp((scores - scores.max(axis=1, keepdims=True)).astype(np.float64))
    ahead, steps = np.zeros_like(local), list(_steps(border))
    for t, at in enumerate(steps):
        now = local[at] if t == 0 else (ahead[steps[t - 1][: len(at)]] @ move) * local[at]
        ahead[at] = now / np.maximum(now.sum(axis=1, keepdims=True), 1e-300)
    behind = np.ones_like(local)
    for t in range(len(steps) - 2, -1, -1):
        after = steps[t + 1]
        at = steps[t][: len(after)]
        right = local[after] * behind[after]
        left = right @ move.T
        if moves is not None:
            mine = ahead[at]
            moves += ((mine / np.maximum((mine * left).sum(axis=1, keepdims=True), 1e-300)).T @ right) * move
        behind[at] = left / np.maximum(left.sum(axis=1, keepdims=True), 1e-300)
    out = ahead * behind
    return out / np.maximum(out.sum(axis=1, keepdims=True), 1e-300)


class _Batch:
    """Sequences as arrays: distinct words and their features, the word and label of each place, borders."""

    def __init__(self, sequences: list[tuple[list[bytes], list[str]]], code: dict[str, int], features: Callable[[list[bytes]], Features]):
        words = sorted({w for s, _ in sequences for w in s})
        number = {w: i for i, w in enumerate(words)}
        self.words, self.parts = len(words), features(words)
        self.owner = [np.repeat(np.arange(len(words)), np.diff(b)) for _, b in self.parts]
        self.which = np.array([number[w] for s, _ in sequences for w in s])
        self.gold = np.array([code[x] for _, y in sequences for x in y])
        self.border = np.concatenate([[0], np.cumsum([len(s) for s, _ in sequences])])
        after = _inside(self.border, len(self.gold), -1)
        self.seen = np.zeros((len(code), len(code)))
        np.add.at(self.seen, (self.gold[after - 1], self.gold[after]), 1)


def train(labels: list[str], features: Callable[[list[bytes]], Features], sequences: list[tuple[list[bytes], list[str]]], buckets: int, contexts: tuple[int, ...] = (0,), rounds: int = 60, rate: float = 0.15, decay: float = 1e-3, batches: int = 1) -> Crf:
    """Maximum likelihood with an L2 penalty by Adam; each round takes one of the batches that the (small) table
    is dealt to, in turn. Deterministic."""
    code, k = {x: i for i, x in enumerate(labels)}, len(labels)
    dealt = [_Batch(sequences[i::batches], code, features) for i in range(min(batches, len(sequences)))]
    model = Crf(labels, buckets, contexts, {c: np.zeros((buckets, k), np.float32) for c in contexts}, np.zeros((k, k), np.float32))
    state: dict = {}

    def adam(name, value, slope, t):
        m, v = state.get(name, (0, 0))
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        state[name] = m, v
        value -= (rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)).astype(np.float32)

    for t in range(1, rounds + 1):
        b = dealt[t % len(dealt)]
        n, pairs = len(b.gold), np.zeros((k, k))
        error = marginals(model.place_scores(b.parts, b.words, b.which, b.border), model.transitions, b.border, pairs)
        error[np.arange(n), b.gold] -= 1
        for c in contexts:
            at = _inside(b.border, n, c)
            by_word = np.stack([np.bincount(b.which[at + c], error[at, j], b.words) for j in range(k)], axis=1)
            slope = decay * model.weights[c]
            for (ids, _), who in zip(b.parts, b.owner, strict=True):
                for j in range(k):
                    slope[:, j] += np.bincount(ids, by_word[who, j], buckets) / n
            adam(c, model.weights[c], slope, t)
        adam("t", model.transitions, (pairs - b.seen) / n + decay * model.transitions, t)
    return model
