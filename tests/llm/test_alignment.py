"""Token alignment against a plain version with the libraries' own tokenizers."""

import hashlib
import json
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cases import awkward, empty
from shoebox.llm import alignment, queries

SMALL = alignment.Alignment(part_bytes=64, block_bytes=2000, fan=2)


@pytest.fixture(scope="module")
def plain():
    """text -> the list of (ids of A with bytes, ids of B with bytes), by the tokenizers themselves."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(alignment.BYTE_MODEL)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=alignment.DEFAULT_MODEL)
    vocab = {i: s for s, i in json.load(open(alignment.BYTE_MODEL, encoding="utf-8"))["model"]["vocab"].items()}
    shown = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or c >= 174]
    table = {chr(c): c for c in shown}
    for k, c in enumerate(c for c in range(256) if c not in shown):
        table[chr(256 + k)] = c

    def encode(text):
        if not text:
            return [], []
        left = [(i, bytes(table[c] for c in vocab[i])) for i in a.encode(" " + text, add_special_tokens=False).ids]
        right = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        whole = (" " + text).encode()
        return (left, right) if b"".join(x for _, x in left) == whole == b"".join(x for _, x in right) else ([], [])

    return encode


def brute(plain, texts):
    """What the contract says, byte by byte: tokens overlap where they share a byte."""
    docs, count = [], Counter()
    for text in texts:
        left, right = plain(text)
        owner = [[k for k, (_, raw) in enumerate(side) for _ in raw] for side in (left, right)]
        links = [(left[x][0], right[y][0]) for x, y in dict.fromkeys(zip(*owner, strict=True))]
        groups, open_ = [], ([], [])
        for at, (x, y) in enumerate(zip(*owner, strict=True)):
            ends = [at + 1 == len(own) or own[at + 1] != own[at] for own in owner]
            if ends[0]:
                open_[0].append(str(left[x][0]))
            if ends[1]:
                open_[1].append(str(right[y][0]))
            if all(ends):
                groups.append("|".join(",".join(side) for side in open_))
                open_ = ([], [])
        spans = (left, right)
        docs.append((spans, links, groups))
        count.update(set(links))
    best = Counter()
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for spans, links, groups in docs:
        out.append((len(spans[0]), len(spans[1]), len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    return out


def run(spark, texts, cfg=alignment.Alignment()):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: tuple(r)[1:] for r in alignment.token_alignment(rows, cfg=cfg).collect()}
    return [got[i] for i in range(len(texts))]


def mixed_texts(n, longest=60):
    rng = random.Random(4)
    words = ["the", "house", "ünïcode", "日本語", "it's", "x1y2", "\n\n", "  ", "\t", "foo-bar", "😀", "3.14", "<s>", "internationalisation", "aaaaaaaaaaaaaaaa", "\r\n", "<|endoftext|>", "　", "ﬁne", "\x00"]
    return ["".join(rng.choice(words) + rng.choice(["", " ", " ", "\n"]) for _ in range(rng.randrange(longest))) for _ in range(n)]


@pytest.mark.parametrize("cfg", [alignment.Alignment(), SMALL])
def test_equals_plain(spark, plain, cfg):
    texts = [None, "", " ", "▁ literal", "a", "a", *mixed_texts(60), "word " * 200, "no_white_space_" * 30]
    assert run(spark, texts, cfg) == brute(plain, texts)


def test_long_text_without_its_bytes_has_no_tokens(spark, plain):
    texts = ["fine words " * 40 + "▁" + " more words" * 40, "fine words " * 80]
    got = run(spark, texts, SMALL)
    assert got == brute(plain, texts)
    assert got[0] == (0, 0, 0, 0, 0, 0, "")


def test_same_table_split_or_whole(spark):
    """sf0.001's documents: with parts of 1,000 bytes in many rounds and with whole texts."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    whole = sorted(alignment.token_alignment(docs).collect(), key=lambda r: r["doc_id"])
    split = sorted(alignment.token_alignment(docs, cfg=alignment.Alignment(part_bytes=1000, fan=3)).collect(), key=lambda r: r["doc_id"])
    assert whole == split


def test_both_libraries_agree():
    """A is run by a faster library: the same ids for every vocabulary entry and for characters of all planes."""
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(alignment.BYTE_MODEL)
    own.encode_special_tokens = True
    t = alignment.tokenizers(open(alignment.BYTE_MODEL, encoding="utf-8").read(), open(alignment.DEFAULT_MODEL, "rb").read())
    texts = ["".join(f"a{chr(c)}b {chr(c)}{chr(c)}1" for c in range(low, low + 64) if not 0xD800 <= c < 0xE000) for low in range(0, 0x30000, 64 * 29)]
    entries = [t.bytes_of(0, [i]) for i in range(t.size_a)]
    texts += [e.decode() for e in entries if e.decode("utf-8", "ignore").encode() == e]
    assert all(own.encode(x, add_special_tokens=False).ids == t.encoded_a(x).tolist() for x in texts)


FRAGMENTS = st.builds(
    lambda first, p, q: alignment.Fragment(first, p, q if first >= 0 else ([], [])),
    st.integers(-1, 3), st.tuples(st.lists(st.integers(0, 9), max_size=3), st.lists(st.integers(0, 9), max_size=3)), st.tuples(st.lists(st.integers(0, 9), max_size=3), st.lists(st.integers(0, 9), max_size=3)),
)


@settings(max_examples=300, deadline=None)
@given(FRAGMENTS, FRAGMENTS, FRAGMENTS)
def test_composition_is_associative(x, y, z):
    left, one = x.then(y)
    left, two = left.then(z)
    right, three = y.then(z)
    right, four = x.then(right)
    assert left == right
    assert sorted(filter(None, (one, two))) == sorted(filter(None, (three, four)))
    assert x.then(alignment.Fragment())[0] == x == alignment.Fragment().then(x)[0]


def test_cases(spark, plain):
    docs = awkward(spark)
    got = sorted((tuple(r) for r in alignment.token_alignment(docs).collect()), key=str)
    rows = docs.collect()
    assert got == sorted(((r["doc_id"], *b) for r, b in zip(rows, brute(plain, [r["text"] for r in rows]), strict=True)), key=str)
    assert alignment.token_alignment(empty(spark)).collect() == []


def test_registered_query_equals_plain(spark, plain, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    short = [r for r in docs if len(r["text"] or "") < 1500]
    got = {r["doc_id"]: tuple(r)[1:5] for r in queries.op12_token_alignment(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for r, wanted in zip(short, brute(plain, [r["text"] for r in short]), strict=True):
        assert got[r["doc_id"]] == wanted[:4]
