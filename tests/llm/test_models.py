"""Toxicity, languages, pieces, neighbours, archives, near duplicates and the pipeline."""

import base64
import gzip
import hashlib
import itertools
import random
import re
import struct
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cases import TEXTS, awkward, empty
from shoebox.llm import crf, decontaminate, langid, neardup, neighbours, pieces, pii, queries, toxicity, warc
from shoebox.llm.common import digest_bucket
from shoebox.llm.graph import connected_components


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# the field


def test_viterbi_and_marginals_against_enumeration():
    rng = np.random.default_rng(2)
    border = np.array([0, 4, 5, 9])
    scores, moves = rng.normal(size=(9, 3)), rng.normal(size=(3, 3))
    best, chance = crf.viterbi(scores, moves, border), crf.marginals(scores, moves, border)
    for a, b in itertools.pairwise(border):
        paths = list(itertools.product(range(3), repeat=b - a))
        value = np.array([sum(scores[a + i, y] for i, y in enumerate(p)) + sum(moves[x, y] for x, y in itertools.pairwise(p)) for p in paths])
        assert tuple(best[a:b]) == paths[value.argmax()]
        weight = np.exp(value) / np.exp(value).sum()
        for i in range(b - a):
            assert chance[a + i] == pytest.approx([weight[[p[i] == y for p in paths]].sum() for y in range(3)])


# toxicity


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(3)
    plain = ["".join(rng.choice(["ba", "ne", "ti", "so", "lu", "ra"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    rows = []
    for i in range(500):
        words = [rng.choice(plain) for _ in range(rng.randint(10, 60))]
        if toxic := i % 3 == 0:
            words[rng.randrange(len(words))] = rng.choice(["grumph", "zworkle"]) + rng.choice(["", "y", "ing", "xo", "ka"])
        rows.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    found = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, labels, digest_bucket("doc_id", 3) != 1).collect()}
    held = [(found[i] >= 0.7, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(p == bool(y) for p, y in held) >= 0.97 * len(held)
    unseen = spark.createDataFrame([(1, "bane zworkleish tiso"), (2, "bane luraso tiso")], "doc_id long, text string")
    model = toxicity.train([t for _, t, _ in rows], [y for _, _, y in rows])
    a, b = model.scores(pa.array([r.text for r in unseen.orderBy("doc_id").collect()]))
    assert a > 0.7 > b


def test_toxicity_query_against_a_plain_scorer(spark, sf_dir):
    """The query's scores are those of a row-by-row loop over its n-grams; on held-out rows it tells the classes apart."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(*zip(*[(r.text, r.toxic) for r in toxicity.training_rows(docs, labels, digest_bucket("doc_id", 3) != 1, "text", "doc_id", toxicity.ToxicityConfig())], strict=True))
    found = {r.doc_id: r for r in queries.op5_toxicity(spark, sf_dir).collect()}
    texts, known = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.toxic for r in labels.collect()}
    for i, text in list(texts.items())[:40]:
        words = [bytes(c if i >= 128 or chr(c).isalnum() or c >= 128 else 32 for c in w) for w in ((text or "").lower().encode(),) for i in (0,)][0].split()
        logit = []
        for w in words:
            flat = np.frombuffer(w, np.uint8)
            one = [x for x, _ in toxicity._grams(flat, np.array([0]), np.array([len(w)]), toxicity.run_hashes(flat, np.array([0]), np.array([len(w)])), model.config)]
            logit.append(np.mean(model.parts[np.concatenate(one).astype(np.int64)].astype(float)))
        worst = max((np.mean(logit[k : k + 3]) for k in range(len(logit))), default=0.0)
        assert found[i].score == pytest.approx(1 / (1 + np.exp(-np.clip(worst + model.bias, -40, 40))), abs=1e-6)
        assert found[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and found[i].predicted == int(found[i].score >= 0.7)
    held = [(r.predicted, known[i]) for i, r in found.items() if r.held_out and i in known]
    assert sum(p == y for p, y in held) >= 0.8 * len(held)


def test_a_repeated_key_is_learnt_from_by_its_smallest_text(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c"), (2, None), (2, "x" * (1 << 16))], "doc_id long, text string")
    for order in ("text", F.desc("text")):
        assert [(r.text, r.toxic) for r in toxicity.training_rows(docs.orderBy(order), labels, F.lit(True), "text", "doc_id", toxicity.ToxicityConfig())] == [("a", 1), ("c", 0)]


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([(5, 1), (6, 0), (5, 0), (None, 1), (4, None)], "doc_id long, toxic int")
    rows = toxicity.score_toxicity(awkward(spark), labels, F.lit(True)).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r.score <= 1 for r in rows)
    assert {round(r.score, 3) for r in toxicity.score_toxicity(awkward(spark), labels.limit(0), F.lit(True)).collect()} == {0.047}
    assert toxicity.score_toxicity(empty(spark), labels, F.lit(True)).count() == 0


# languages


def test_languages_on_held_out_rows(spark, sf_dir):
    docs = {r.doc_id: r.lang for r in table(spark, sf_dir, "documents").collect()}
    rows = [r for r in queries.op9_language(spark, sf_dir).collect() if r.held_out]
    assert rows and all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    assert sum(r.lang_pred == docs[r.doc_id] for r in rows) >= 0.97 * len(rows)


def test_code_switched_words(spark, sf_dir):
    rows = [(r.text, r.lang) for r in table(spark, sf_dir, "documents").filter("text is not null").collect()]
    model = langid.train(rows)
    pick = {lang: next(t for t, x in reversed(rows) if x == lang and len(t.split()) > 60).split()[:30] for lang in ("fr", "de")}
    _, _, border, chance = langid.label_words(model, pa.array([" ".join(pick["fr"] + pick["de"])]))
    names = [model.field.labels[k] for k in chance.argmax(axis=1)]
    assert border[-1] == len(names) and names[:20].count("fr") >= 17 and names[-20:].count("de") >= 17


def test_130_languages(spark):
    """Every language is learnt, and none shares its lexicon mark with another."""
    rng = random.Random(7)
    speech = {f"l{i:03}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéöñ") for _ in range(rng.randint(3, 8))) for _ in range(30)] for i in range(130)}
    rows = [(k, " ".join(rng.choice(words) for _ in range(40)), lang) for k, (lang, words) in enumerate((x for x in speech.items() for _ in range(4)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    cfg = langid.LanguageConfig(rounds=12, pieces=1)
    found = langid.identify_languages(docs, F.col("doc_id") % 4 != 0, cfg=cfg).collect()
    held = [(r.lang_pred, rows[r.doc_id][2]) for r in found if r.doc_id % 4 == 0]
    assert len(held) == 130 and sum(a == b for a, b in held) >= 125
    assert len({langid.language_set([i]) for i in range(5000)}) == 5000
    border, scores = np.array([0, 3]), np.zeros((3, 200))
    scores[:, 180] = 5.0
    assert crf.viterbi(scores, np.zeros((200, 200)), border).tolist() == [180] * 3


def test_a_hot_key_brings_one_training_row(spark):
    docs = spark.createDataFrame([(1, "one text", "en")] * 500 + [(2, "ein Text", "de"), (3, "x" * 40_000, "de")], "doc_id long, text string, lang string")
    got = langid.training_rows(docs, F.lit(True), "text", "lang", "doc_id", langid.LanguageConfig())
    assert sorted(got) == [("ein Text", "de"), ("one text", "en"), ("x" * (1 << 15), "de")]  # a long text is cut, not left out


def test_language_edges(spark):
    rows = {r.doc_id: r for r in langid.identify_languages(awkward(spark), F.lit(True)).collect()}
    assert [rows[i].lang_pred for i in (1, 2, 3, 10)] == ["und"] * 4 and rows[4].lang_pred == "en" and 0 <= rows[4].score <= 1
    assert langid.identify_languages(empty(spark), F.lit(True)).count() == 0
    assert {r.lang_pred for r in langid.identify_languages(awkward(spark), F.lit(False)).collect()} == {"und"}


# pieces


def best_score(vocabulary, known, text):
    data = (" " + text).encode()
    best = [0.0] + [-1e30] * len(data)
    for e in range(1, len(data) + 1):
        for s in range(max(0, e - 48), e):
            piece = known.get(data[s:e])
            gain = vocabulary.score[piece] if piece is not None else vocabulary.spelt if e - s == 1 else None
            if gain is not None:
                best[e] = max(best[e], best[s] + gain)
    return best[-1]


def test_pieces_against_a_plain_viterbi():
    v = pieces.load_vocabulary()
    raw = [v.flat[a:b].tobytes() for a, b in itertools.pairwise(v.border)]
    known = {r: i for i, r in enumerate(raw) if r and not v.is_byte[i]}
    rng = random.Random(8)
    texts = ["Hello  world\n é ▁x", " a  b ", "日本語 😀😀", "   ", *("".join(rng.choice("ab théin ▁é\n日 .,") for _ in range(rng.randint(1, 60))) for _ in range(150))]
    ids, border = pieces.encode_batch(v, pa.array(texts))
    for text, a, b in zip(texts, border[:-1], border[1:], strict=True):
        assert sum(v.spelt if v.is_byte[i] else v.score[i] for i in ids[a:b]) == pytest.approx(best_score(v, known, text))
    assert pieces.decode_batch(v, ids, border) == [t.encode() for t in texts]


def test_double_array_holds_all_keys():
    keys = {bytes(k): i for i, k in enumerate({tuple(random.Random(i).choices(range(256), k=1 + i % 5)) for i in range(2000)})}
    base, check, value = pieces.double_array(keys)
    for key, wanted in keys.items():
        s = 0
        for b in key:
            t = base[s] + b + 1
            assert check[t] == s
            s = t
        assert value[s] == wanted


def unigram_model(path, pieces_and_scores):
    """A unigram model file by hand: the wire format of its few fields."""
    number = lambda n: bytes([n]) if n < 128 else bytes([n & 127 | 128]) + number(n >> 7)
    field = lambda k, body: number(k << 3 | 2) + number(len(body)) + body
    flag = lambda k, n: number(k << 3) + number(n)
    entry = lambda text, score, kind: field(1, field(1, text.encode()) + number(2 << 3 | 5) + struct.pack("<f", score) + flag(3, kind))
    rows = [entry("<unk>", 0, 2), entry("<s>", 0, 3), entry("</s>", 0, 3), *(entry(f"<0x{b:02X}>", 0, 6) for b in range(256)), *(entry(t, s, 1) for t, s in pieces_and_scores)]
    trainer = field(2, flag(3, 1) + flag(35, 1))
    plain = field(3, field(1, b"identity") + flag(3, 1) + flag(4, 0) + flag(5, 1))
    path.write_bytes(b"".join(rows) + trainer + plain)
    return str(path)


def test_pieces_of_a_unigram_model_are_those_of_the_library(tmp_path):
    import sentencepiece

    rng = random.Random(14)
    known = {"▁": -3.0, **{c: -rng.uniform(4, 7) for c in "abcdeé"}}
    while len(known) < 300:
        known.setdefault(("▁" if rng.random() < 0.4 else "") + "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))), -rng.uniform(3, 12))
    path = unigram_model(tmp_path / "unigram.model", sorted(known.items()))
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), pieces.load_vocabulary(path)
    texts = ["".join(rng.choice("abcdeé    ") for _ in range(rng.randint(1, 80))) for _ in range(300)] + ["abc" * 500, "a", "  ab"]
    ids, border = pieces.encode_batch(own, pa.array(texts))
    for text, a, b in zip(texts, border[:-1], border[1:], strict=True):
        assert ids[a:b].tolist() == library.encode(text), text
    assert pieces.decode_batch(own, ids, border) == [t.encode() for t in texts]


def test_a_long_text_without_spaces_is_cut_where_no_piece_goes_across():
    v, rng = pieces.load_vocabulary(), random.Random(3)
    text = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(2_000_000))
    began = time.perf_counter()
    ids, border = pieces.encode_batch(v, pa.array([text]))
    assert pieces.decode_batch(v, ids, border) == [text.encode()] and time.perf_counter() - began < 60


def test_piece_round_trip_and_edges(spark):
    docs = awkward(spark)
    found = pieces.encode_pieces(docs)
    assert found.filter("not exact").count() == 0 and found.count() == len(TEXTS) and pieces.encode_pieces(empty(spark)).count() == 0
    back = sorted((r.doc_id or 0, r.text) for r in pieces.decode_pieces(found).collect())
    assert back == sorted((i or 0, t or "") for i, t in TEXTS)
    assert pieces.decode_pieces(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")).orderBy("doc_id").collect()[0].text is None


# neighbours


def test_recall(spark, sf_dir):
    rows = table(spark, "/root/testdata/sf0.01", "embeddings").select("vec_id", "embedding")
    pdf = rows.toPandas()
    vectors, ids, found = np.stack(pdf.embedding).astype(float), pdf.vec_id.to_numpy(), {}
    for r in neighbours.nearest_neighbours(rows, F.col("vec_id") % 20 == 0).collect():
        found.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    hits = 0
    for q, mine in found.items():
        inner = vectors @ vectors[ids == q][0]
        order = [(s, i) for s, i in sorted(zip(-inner, ids, strict=True)) if i != q][:20]
        hits += len({i for _, i in order} & {i for i, _ in mine.values()})
        assert list(mine) and [mine[k] for k in sorted(mine)] == sorted(mine.values(), key=lambda x: (-x[1], x[0]))
    assert hits >= 0.9 * 20 * len(found)


def test_neighbour_edges(spark):
    vectors = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [0.5, 0.5]), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (9, [float("inf"), 0.0]), (10, [])]
    rows = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("id", "v", "asks", "block", "score", "rank")})
    out = neighbours.nearest_neighbours(rows, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in out] == [(0, 1, 1, 1.0), (0, 2, 7, 1.0), (0, 3, 6, 0.5)]
    assert neighbours.nearest_neighbours(rows.limit(0), F.col("vec_id") == 0).count() == 0
    assert neighbours.nearest_neighbours(rows, F.col("vec_id") == 99).count() == 0


def recall_by_query(spark, vectors, queries, k=20):
    """Shares of the true k nearest found, and numbers of rows, by query."""
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    found = {q: set() for q in queries}
    for r in neighbours.nearest_neighbours(rows, F.col("vec_id").isin(queries), k=k).collect():
        found[r.query_id].add(r.vec_id)
    recall = []
    for q, mine in found.items():
        inner = vectors @ vectors[q]
        best = [i for _, i in sorted((-s, i) for i, s in enumerate(inner)) if i != q][:k]
        recall.append(len(mine & set(best)) / len(best))
    return np.array(recall), [len(x) for x in found.values()]


def test_queries_outside_a_hot_group_are_not_left_short(spark):
    rng = np.random.default_rng(5)
    hot, others = rng.normal(size=32) + 1e-3 * rng.normal(size=(1000, 32)), rng.normal(size=(2000, 32))
    vectors = np.concatenate([hot, others])
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    recall, rows = recall_by_query(spark, vectors, list(range(0, 3000, 50)))
    assert set(rows) == {20} and recall.min() >= 0.9


def test_clusters_isolated_vectors_and_uneven_lengths(spark):
    rng = np.random.default_rng(9)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    centres = unit(rng.normal(size=(9, 24)))
    mixed = np.concatenate([unit(np.repeat(centres, 150, axis=0) + 0.03 * rng.normal(size=(1350, 24))), unit(rng.normal(size=(250, 24)))])
    uneven = rng.normal(size=(1600, 24)) * rng.lognormal(0, 1, size=(1600, 1))
    for vectors in (mixed, uneven):
        recall, rows = recall_by_query(spark, vectors, list(range(0, 1600, 20)))
        assert set(rows) == {20} and recall.mean() >= 0.95 and np.sort(recall)[:8].mean() >= 0.9


def test_a_repeated_key_counts_once_with_its_smallest_vector(spark):
    vectors = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [2.0, 1.0]), (3, [1.0, 3.0])]
    for order in (vectors, vectors[::-1]):
        out = neighbours.nearest_neighbours(spark.createDataFrame(order, "vec_id long, embedding array<float>"), F.col("vec_id") == 1).orderBy("rank").collect()
        assert [(r.vec_id, r.score) for r in out] == [(3, 3.0), (2, 1.0)]


def test_fewer_vectors_than_neighbours_give_all_of_them(spark):
    recall, rows = recall_by_query(spark, np.random.default_rng(6).normal(size=(15, 8)), list(range(15)))
    assert set(rows) == {14} and recall.min() == 1


# archives


def test_magic_in_payloads_and_duplicates(spark, tmp_path):
    inner = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    bodies = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "x" + inner), (6, "WARC/1.1\r\n" * 3), (7, inner * 2 + "é" * 5000), (8, "a"), (None, "b"), (9, "b"), (9, "b"), (10, "line\r\n\r\nline")]
    pages = spark.createDataFrame([(i, "http://h/\r\nx", t) for i, t in bodies], "page_id long, url string, html string").withColumn("bytes", F.lit(1)).withColumn("first", F.lit(1))
    warc.write_warc(pages.coalesce(2), str(tmp_path / "w"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (old, "3000"):  # small splits cut files between and inside records
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = warc.read_warc(spark, str(tmp_path / "w")).collect()
            assert len(rows) == len(bodies) and all(r.intact for r in rows)
            got = sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to or 0) for r in rows)
            size_of = lambda t: len((t or "").encode())
            last = {}
            for i, t in bodies:
                last[t or ""] = max(last.get(t or "", -1), i or -1)
            assert got == sorted((i or 0, size_of(t), "revisit" if i and i < last[t or ""] else "response", last[t or ""] if i and i < last[t or ""] else 0) for i, t in bodies)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    warc.write_warc(pages.limit(0), str(tmp_path / "none"))
    assert warc.read_warc(spark, str(tmp_path / "none")).count() == 0


def test_old_versions_and_packed_archives(spark, tmp_path):
    record = lambda version, page, body: f"WARC/1.{version}\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{page}>\r\nContent-Length: {len(body)}\r\n\r\n{body}\r\n\r\n".encode()
    (tmp_path / "old").mkdir()
    (tmp_path / "old/a.warc").write_bytes(record(0, 1, "abc") + record(0, 2, "WARC/1.0\r\n WARC/1.1 x") + record(1, 3, "d"))
    (tmp_path / "old/b.warc.gz").write_bytes(b"".join(gzip.compress(record(i % 2, 10 + i, "WARC/1." * i)) for i in range(5)))
    rows = warc.read_warc(spark, str(tmp_path / "old")).collect()
    assert sorted((r.page_id, r.payload_bytes) for r in rows) == [(1, 3), (2, 21), (3, 1), *((10 + i, 7 * i) for i in range(5))]
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/c.warc").write_bytes(b"no archive at all")
    with pytest.raises(ValueError):
        warc.read_warc(spark, str(tmp_path / "bad"))


def test_archives_of_others(spark, tmp_path):
    """A resource record with a blank line is all payload; ids that are no page numbers are kept as texts; a response of another type has no head."""
    def record(kind, ident, body, content_type, more=""):
        digest = base64.b32encode(hashlib.sha1(body.split("\r\n\r\n", 1)[1].encode() if content_type.startswith("application/http") else body.encode()).digest()).decode()
        return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {ident}\r\nWARC-Payload-Digest: sha1:{digest}\r\n{more}Content-Type: {content_type}\r\nContent-Length: {len(body)}\r\n\r\n{body}\r\n\r\n"

    (tmp_path / "w").mkdir()
    (tmp_path / "w/a.warc").write_text(record("resource", "<urn:uuid:1>", "abcdefgh\r\n\r\nijklmnop", "text/plain") + record("response", "<urn:uuid:2>", "HTTP/1.1 200 OK\r\nA: b\r\n\r\nxyz", "application/http; msgtype=response") + record("metadata", "<urn:uuid:3>", "k: v", "application/warc-fields", "WARC-Refers-To: <urn:uuid:2>\r\n"), newline="")
    rows = {r.record_id: r for r in warc.read_warc(spark, str(tmp_path / "w")).collect()}
    assert {i: (r.payload_bytes, r.intact, r.page_id) for i, r in rows.items()} == {"<urn:uuid:1>": (20, True, None), "<urn:uuid:2>": (3, True, None), "<urn:uuid:3>": (4, True, None)}
    assert rows["<urn:uuid:3>"].refers_to_id == "<urn:uuid:2>" and rows["<urn:uuid:1>"].refers_to_id is None


def test_damaged_chain_ends_there(spark, tmp_path):
    good = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    wrong = good.replace("Length: 3", "Length: 9")
    (tmp_path / "one.warc").write_bytes((good + wrong + good).encode())
    assert warc.read_warc(spark, str(tmp_path)).count() == 2


# near duplicates


def components(texts, k, percent=80):
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            low, high = sorted((top(a), top(b)))
            up[high] = low
    return {i: (len(sets[i]), top(i)) for i in sets}


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(12)
    texts, vocabulary = [], [f"w{i}" for i in range(400)]
    for g in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(30, 120))]
        for _ in range(rng.randint(1, 14)):
            copy = list(base)
            for _ in range(rng.randint(0, 9)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append((len(texts) * 7 + g, " ".join(copy).upper() if g % 2 else " ".join(copy)))
    chain = [rng.choice(vocabulary) for _ in range(100)]  # each is near the one before only
    for step in range(12):
        chain[step * 4 : step * 4 + 4] = [f"c{step}{j}" for j in range(4)]
        texts.append((10_000 + step, " ".join(chain)))
    texts += [(20_000, None), (20_001, ""), (20_002, " \t "), (20_003, "solo"), (20_004, "SOLO"), (20_005, "a b"), (20_006, "a b")]
    rng.shuffle(texts)
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    for cfg in (neardup.MinHash(shingle=2, block=3, slice_rows=2), neardup.MinHash(), neardup.MinHash(block_shingles=150)):
        wanted = components(texts, cfg.shingle)
        for r in neardup.near_duplicates(docs, cfg=cfg).collect():
            assert (r.n_shingles, r.component_id) == wanted[r.doc_id] and r.kept == (r.component_id == r.doc_id)


def test_repeated_keys_link_all_their_texts(spark):
    rng = random.Random(31)
    one, two = ([rng.choice("abcdefghij") + str(rng.randint(0, 99)) for _ in range(60)] for _ in range(2))
    near = lambda words: [*words[:-1], "changed"]
    rows = [(1, " ".join(one)), (1, " ".join(two)), (2, " ".join(near(one))), (3, " ".join(near(two))), (4, "else"), (4, ""), (5, " ".join(one)), (5, " ".join(one)), (7, "zz yy xx"), (7, "else")]
    for order, name in ((rows, lambda i: i), (rows[::-1], lambda i: 10 - i)):  # also so that the smallest key is another text's
        docs = spark.createDataFrame([(name(i), t) for i, t in order], "doc_id long, text string").repartition(3)
        found = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).filter("n_shingles > 0").collect()}
        assert found == {name(i): min(map(name, group)) for group in ((1, 2, 3, 5), (4, 7)) for i in group}


def test_near_duplicate_query_against_all_pairs(spark, sf_dir):
    wanted = components([(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()], 2)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op7_near_duplicates(spark, sf_dir).collect()}
    assert found == wanted


def test_near_duplicate_edges(spark):
    rows = neardup.near_duplicates(awkward(spark)).collect()
    assert len(rows) == len(TEXTS) and all(r.kept for r in rows if r.doc_id != 8) and sum(r.component_id is None for r in rows) == 1
    assert neardup.near_duplicates(empty(spark)).count() == 0


def test_components_of_a_long_chain(spark, tmp_path):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 102)], "a long, b long")
    out = {r.node: r.component for r in connected_components(edges, str(tmp_path / "cc")).collect()}
    assert out == {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100}


# the pipeline


def test_pipeline_stage_by_stage(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    v = pieces.load_vocabulary()
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in kept.collect()}
        kept = stage(spark, kept, sf_dir).cache()
        after = {r.doc_id: r for r in kept.collect()}
        assert set(after) <= set(before)
        if name == "near_duplicates":
            assert set(after) == {i for i, (_, c) in components(list(before.items()), 5).items() if c == i}
        elif name == "decontamination":
            items = [decontaminate.words_of(r.text) for r in table(spark, sf_dir, "benchmark").collect()]
            windows = {b" ".join(w[i : i + 13]) for w in items for i in range(max(len(w) - 12, min(len(w), 1)))}
            for i, t in before.items():
                words = decontaminate.words_of(t)
                hit = {k for j in range(len(words)) for n in {w.count(b" ") + 1 for w in windows} if b" ".join(words[j : j + n]) in windows for k in range(j, j + n)}
                assert (i in after) == (not (hit and 20 * len(hit) >= len(words)))
        elif name == "personal_data":
            assert set(after) == set(before) and not any(pii.base_spans(r.text or "") for r in after.values())
        elif name == "pieces":
            assert set(after) == set(before) and all(r.exact for r in after.values())
            for i, r in after.items():
                assert pieces.decode_batch(v, np.array(r.ids, np.int64), np.array([0, len(r.ids)])) == [(before[i] or "").encode()]
        if name != "pieces":
            assert kept.columns == docs.columns


def test_pipeline_on_awkward_rows(spark, sf_dir, tmp_path):
    awkward(spark).write.parquet(str(tmp_path / "documents.parquet"))
    for t in ("labels", "benchmark"):
        table(spark, sf_dir, t).write.parquet(str(tmp_path / f"{t}.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id or 0 for r in out) == [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10]
