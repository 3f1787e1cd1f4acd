"""Near duplicates among embeddings against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoebox.llm import itq

SCHEMA = "vec_id long, embedding array<float>, label int"


def all_pairs(vectors: dict, least: float) -> tuple[dict, dict]:
    """Links and components by brute force; vectors may hold None for those that take no part."""
    ids = [i for i, v in vectors.items() if v is not None]
    unit = np.array([np.asarray(vectors[i], float) / np.linalg.norm(np.asarray(vectors[i], float)) for i in ids])
    near = unit @ unit.T >= least
    np.fill_diagonal(near, False)
    links = dict.fromkeys(vectors, 0) | {i: int(near[k].sum()) for k, i in enumerate(ids)}
    component = {i: i for i in vectors}
    changed = True
    while changed:
        changed = False
        for k, i in enumerate(ids):
            low = min([component[i], *(component[ids[j]] for j in np.flatnonzero(near[k]))])
            changed |= low != component[i]
            component[i] = low
    return links, component


def found(spark, vectors, **settings):
    rows = spark.createDataFrame([(i, None if v is None else [float(x) for x in v], 0) for i, v in vectors.items()], SCHEMA)
    cfg = itq.Quantisation(**settings)
    return {r["vec_id"]: r for r in itq.similar_embeddings(rows, cfg=cfg).collect()}


def turned(rng, v, angle):
    other = rng.normal(size=len(v))
    other -= (other @ v) * v / (v @ v)
    return np.linalg.norm(v) * (np.cos(angle) * v / np.linalg.norm(v) + np.sin(angle) * other / np.linalg.norm(other))


def test_registered_query_equals_all_pairs(spark):
    sf = "/root/testdata/sf0.01"
    from shoebox.llm import queries

    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    wanted = all_pairs({r["vec_id"]: r["embedding"] for r in rows.collect()}, 0.9)
    got = queries.op11_similar_embeddings(spark, sf).collect()
    assert len(got) == rows.count()
    assert {r["vec_id"]: r["n_links"] for r in got} == wanted[0]
    assert {r["vec_id"]: r["component_id"] for r in got} == wanted[1]


@pytest.mark.parametrize("settings", [{}, {"block": 16, "crowd": 512, "heavy": 4}, {"heavy": 10**6, "block": 32}])
def test_groups_of_copies(spark, settings):
    """A clump of a third of all rows, exact copies, chains of near copies and two clumps near each other: equal to all pairs."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(500, 48))
    vectors = dict(enumerate(base))
    at = 1000
    for _ in range(300):
        vectors[at] = turned(rng, base[0], 0.1)
        at += 1
    for _ in range(60):  # its centre is 25 degrees from the large clump's
        vectors[at] = turned(rng, turned(np.random.default_rng(1), base[0], 0.43), 0.06)
        at += 1
    for _ in range(100):
        vectors[at] = base[1] * 3
        at += 1
    chain = base[2]
    for _ in range(12):
        chain = turned(rng, chain, 0.25)
        vectors[at] = chain
        at += 1
    vectors = {k: v.astype(np.float32) for k, v in vectors.items()}
    links, component = all_pairs(vectors, 0.9)
    got = found(spark, vectors, **settings)
    total = sum(links.values())
    assert sum(abs(got[i]["n_links"] - links[i]) for i in vectors) <= 0.01 * total
    assert all(got[i]["n_links"] <= links[i] for i in vectors)
    assert sum(got[i]["component_id"] != component[i] for i in vectors) <= 5
    assert all(got[i]["kept"] == (got[i]["component_id"] == i) for i in vectors)


def test_recall_at_the_least_cosine(spark):
    """Pairs between the least cosine and a little more: at least 0.9 of them are found, in blocks of any size, and none below it."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(1500, 64))
    vectors = {i: v for i, v in enumerate(base)} | {10000 + i: turned(rng, v, 0.448) for i, v in enumerate(base)} | {20000 + i: turned(rng, v, 0.456) for i, v in enumerate(base[:300])}
    links, _ = all_pairs(vectors, 0.9)
    got = found(spark, vectors)
    hit = sum(r["n_links"] for r in got.values())
    assert hit >= 0.9 * sum(links.values())
    assert all(got[i]["n_links"] <= links[i] for i in vectors)


def test_cases(spark):
    """Nulls, zero and broken vectors, another dimension, repeated keys, scaled and opposite vectors, a null key, clashing columns."""
    rows = [(1, [1.0, 0.0, 0.0]), (2, [2.0, 0.1, 0.0]), (3, [-1.0, 0.0, 0.0]), (4, None), (5, []), (6, [0.0, 0.0, 0.0]), (7, [float("nan"), 1.0, 1.0]), (8, [1.0, None, 0.0]), (9, [1.0, 0.0]),
            (10, [0.0, 0.0, 1.0]), (10, [0.0, 1.0, 0.0]), (None, [1.0, 0.0, 0.0]), (None, None), (11, [0.0, 0.0, 5.0]), (12, [float("inf"), 0.0, 0.0]), (13, [1.0, 0.0, -0.0]), (14, [1.0, 0.0, 0.0])]
    given = spark.createDataFrame([(i, v) for i, v in rows], "vec_id long, embedding array<float>").withColumns({c: F.lit("clash") for c in ("id", "v", "node", "ball", "n_links", "kept", "bucket", "label")})
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in itq.similar_embeddings(given).collect()}
    alone = {i: (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 11, 12)}
    alone.pop(11)
    linked = {1: (3, 1, True), 2: (3, 1, False), 13: (3, 1, False), 14: (3, 1, False), 10: (1, 10, True), 11: (1, 10, False)}  # of key 10's two vectors the smaller counts
    assert got == alone | linked | {None: (0, None, True)}
    assert itq.similar_embeddings(given.limit(0)).collect() == []
    assert len(itq.similar_embeddings(given.filter("embedding is null")).collect()) == 2
