"""Source divergence against a plain version, and the square trees against the matrix they stand for."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cases import awkward, empty
from shoebox.llm import divergence

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string"


def plain(rows, least=10, top=10):
    """(lang, source, part, item, value, rank) from (text, lang, source), in whole numbers."""
    docs, count = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        count[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang in {k[0] for k in count}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        sources = [s for n, s in count if n == lang]
        whole = sum((count[lang, s] for s in sources), Counter())
        p = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}
        shares, q = {s: p(count[lang, s]) for s in sources}, p(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(o, sum(f(shares[s][t], shares[o][t]) for t in kept)) for o in sources if o != s]
            words = [(t, f(shares[s][t], q[t])) for t in kept if count[lang, s][t] and shares[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", words)):
                items = sorted(items, key=lambda i: (-i[1], i[0].encode()))[: top if part == "term" else None]
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(items)]
    return sorted(out)


def run(spark, rows, **settings):
    given = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in divergence.source_divergence(given, cfg=divergence.Audit(**settings)).collect())


@pytest.mark.parametrize("settings", [{"documents": 3}, {"documents": 2, "levels": 2, "spread": 3}, {"documents": 1, "levels": 1}])
def test_equals_plain(spark, settings):
    rng = np.random.default_rng(3)
    words = [f"w{chr(97 + a)}{chr(97 + b)}" for a in range(12) for b in range(12)] + ["ÄÖ", "日本", "It", "IT", "it"]
    rows = []
    for _ in range(300):
        source = f"s{int(rng.integers(0, 13)) if rng.random() > 0.3 else 0}"
        some = rng.zipf(1.3, int(rng.integers(0, 40))) % len(words)
        rows.append((" ".join(words[k] for k in some) + rng.choice(["", "!", " 12 "]), rng.choice(["en", "de", None]), source if rng.random() > 0.1 else None))
    rows += [(None, "en", "no text"), ("", "xx", "a"), (None, "xx", "b"), ("rare only", "yy", "c"), ("rare only", "yy", "c")]
    assert run(spark, rows, **settings) == plain(rows, settings["documents"])


def test_cases(spark):
    docs = awkward(spark)
    rows = [(r["text"], r["lang"], r["source"]) for r in docs.collect()]
    for least in (1, 10):
        got = sorted(tuple(r) for r in divergence.source_divergence(docs, cfg=divergence.Audit(documents=least)).collect())
        assert got == plain(rows, least)
    assert divergence.source_divergence(empty(spark)).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.tuples(st.integers(0, 7), st.integers(0, 7)), st.integers(1, 9), max_size=30), st.dictionaries(st.tuples(st.integers(0, 7), st.integers(0, 7)), st.integers(1, 9), max_size=30), st.integers(1, 8), st.booleans())
def test_walk_covers_each_cell_once(x, y, width, same):
    """For each pair of rows, columns priced as empty in both and columns with a count make up the width, with the right counts."""
    grids, trees = [], []
    for cells in (x, x if same else y):
        cells = {k: n for k, n in cells.items() if k[1] < width}
        grid = np.zeros((8, 8), np.int64)
        for (r, c), n in cells.items():
            grid[r, c] = n
        tree = None
        if cells:
            made = divergence.SquareTree.of(*(np.array(v) for v in ([r for r, _ in cells], [c for _, c in cells], list(cells.values()))), 3)
            tree = divergence.SquareTree.unpacked(*made.packed(), 3)
        grids.append(grid[:, :width])
        trees.append(tree)
    priced, (i, j, n, m) = divergence.walked(trees[0], trees[0] if same else trees[1], (8, 8), width, 3, same)
    seen = Counter(zip(i.tolist(), j.tolist(), n.tolist(), m.tolist(), strict=True))
    for a in range(8):
        for b in range(a + 1 if same else 0, 8):
            wanted = Counter((a, b, int(p), int(q)) for p, q in zip(grids[0][a], grids[1][b], strict=True) if p or q)
            assert priced[a, b] == width - sum(wanted.values())
            assert Counter({k: v for k, v in seen.items() if k[:2] == (a, b)}) == wanted


def test_shares_are_exact():
    counts, whole = [0, 1, 7, 10**9, 5 * 10**12, 9 * 10**14], 9 * 10**15 - 1
    assert divergence.share(np.array(counts), np.full(len(counts), whole)).tolist() == [1 + 10**9 * (c + 2) // whole for c in counts]
