"""Work done in slices gives what it gives at once."""

from dataclasses import replace

import numpy as np

from shoebox.llm import common, toxicity


def test_run_hashes_in_slices():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 123, 4000).astype(np.uint8)
    data[rng.random(4000) < 0.2] = 32
    data[1000:1700] = 99  # one run longer than most slices
    starts, ends = common.spans_of(common.SPACED_WORD[data], np.array([0, len(data)]))
    step, plain = int(common.STEP), []
    for a, b in zip(starts, ends, strict=True):
        plain.append(sum(int(common.BYTE_KEYS[x]) * pow(step, i, 2**64) for i, x in enumerate(data[a:b])) % 2**64)
    expected = common.mixed(np.array(plain, np.uint64))
    for most in (1, 2, 7, 64, 699, 700, 4000, 1 << 17):
        assert (common.run_hashes(data, starts, ends, most) == expected).all()
    assert len(common.run_hashes(data, starts[:0], ends[:0])) == 0


def test_training_in_slices():
    rng = np.random.default_rng(5)
    nice, nasty = ["river", "stone", "lamp", "garden", "window", "paper"], ["grolp", "snarv", "blickt"]
    texts, toxic = [], []
    for i in range(120):
        words = list(rng.choice(nice, rng.integers(0, 30)))
        if i % 3 == 0:
            words.insert(int(rng.integers(0, len(words) + 1)), str(rng.choice(nasty)))
        texts.append(" ".join(words))
        toxic.append(int(i % 3 == 0))
    whole = toxicity.ToxicityConfig(buckets=1 << 12, rounds=20)
    at_once = toxicity.train(texts, toxic, whole)
    for part in (1, 13, 500):
        sliced = toxicity.train(texts, toxic, replace(whole, part=part))
        assert np.abs(sliced.parts - at_once.parts).max() < 1e-3 and abs(sliced.bias - at_once.bias) < 1e-3
    blank = toxicity.train(["", " ", ""], [1, 0, 0], replace(whole, part=2))
    assert np.isfinite(blank.bias) and np.isfinite(blank.parts).all()
