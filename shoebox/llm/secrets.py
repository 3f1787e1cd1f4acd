"""Secret scans through trigram posting lists.

Each rule's regular expression is turned into a Boolean query over trigrams that every match must
contain. Each block of rows gets an inverted index (trigram -> rows) over the trigrams that some
rule asks for; the rule's posting lists are intersected, and only the surviving rows see the
regular expression. A rule without mandatory trigrams is run over every row. The index lives with
its block, as in any document-partitioned search index, so nothing is shuffled and hot keys don't exist.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as K
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import ASCII_LOWER, sha256_hex, text_slices, utf8


@dataclass(frozen=True)
class Rule:
    """A kind of secret. A match counts if group has least characters; a match that fails is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    ignore_case: bool = False
    base: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.ignore_case else 0))

    def searched(self) -> re.Pattern:
        """What is run over a text: if the pattern is one class repeated once or more, and its matches must have least
        characters, the same class repeated so often. Runs that are too short are then no matches instead of dropped ones."""
        parsed = list(_parser.parse(self.pattern))
        if self.group == 0 and self.least > 1 and len(parsed) == 1 and parsed[0][0] is K.MAX_REPEAT:
            low, high, inner = parsed[0][1]
            if low == 1 and high is K.MAXREPEAT and len(inner) == 1 and inner[0][0] is K.IN and self.pattern.endswith("]+"):
                return re.compile(f"{self.pattern[:-1]}{{{self.least},}}", self.compiled().flags)
        return self.compiled()


# The three base kinds, in the order in which spans with equal starts are listed.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, False, True),
    Rule("hex", r"[0-9a-f]+", 0, 24, False, True),
)
#: Public credential formats that the method adds.
MORE_RULES = (
    Rule("forge", r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("pay", r"(?:sk|rk)_live_[A-Za-z0-9]{16,}"),
    Rule("maps", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES


def _cross(heads: set[str], tails: set[str]) -> set[str] | None:
    out = {a + b for a in heads for b in tails}
    return out if len(out) <= 64 else None


def _strings(items) -> list[set[str] | None]:
    """The parsed pattern as a row of pieces: the few strings a piece can be, or None (anything)."""
    pieces: list[set[str] | None] = []
    for op, arg in items:
        if op is K.LITERAL:
            pieces.append({chr(arg)})
        elif op is K.IN and len(arg) <= 8 and all(o is K.LITERAL for o, _ in arg):
            pieces.append({chr(a) for _, a in arg})
        elif op is K.SUBPATTERN:
            pieces += _strings(arg[3])
        elif op is K.BRANCH:
            whole: set[str] | None = set()
            for branch in arg[1]:
                one: set[str] | None = {""}
                for piece in _strings(branch):
                    one = _cross(one, piece) if one is not None and piece is not None else None
                whole = whole | one if whole is not None and one is not None else None
            pieces.append(whole)
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT) and arg[1] <= 2:
            inner: set[str] | None = {""}
            for piece in _strings(arg[2]):
                inner = _cross(inner, piece) if inner is not None and piece is not None else None
            repeated: set[str] | None = {""}
            whole = set() if arg[0] else {""}
            for n in range(1, arg[1] + 1):
                repeated = _cross(repeated, inner) if repeated is not None and inner is not None else None
                if n >= arg[0]:
                    whole = whole | repeated if whole is not None and repeated is not None else None
            pieces.append(whole)
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT) and arg[0] >= 1:
            pieces += [*_strings(arg[2]) * arg[0], None]
        else:
            pieces.append(None)
    return pieces


def trigram_query(rule: Rule) -> list[list[set[bytes]]]:
    """AND of ORs of ANDs: each clause lists alternatives, each a set of (lower-cased) trigrams that
    all occur. Empty: nothing is mandatory, and the rule has to look at every row."""
    clauses, run = [], {""}

    def close(strings: set[str]) -> None:
        if strings and all(len(s) >= 3 for s in strings):
            lowered = [s.encode().translate(ASCII_LOWER) for s in sorted(strings)]
            grams = [{s[i : i + 3] for i in range(len(s) - 2)} for s in lowered]
            clauses.append([g for i, g in enumerate(grams) if not any(h < g or h == g and j < i for j, h in enumerate(grams))])

    for piece in [*_strings(_parser.parse(rule.pattern)), None]:
        longer = _cross(run, piece) if piece is not None else None
        if longer is None:
            close(run)
            run = piece or {""}
        else:
            run = longer
    return clauses


class BlockIndex:
    """The inverted index of one block of rows, over the trigrams in wanted."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray, number: np.ndarray):
        """wanted: 2**24 booleans; number: the sorted trigram codes."""
        low = np.frombuffer(ASCII_LOWER, np.uint8)[data].astype(np.uint32)
        codes = (low[:-2] << 16) | (low[1:-1] << 8) | low[2:] if len(low) > 2 else np.zeros(0, np.uint32)
        at = np.flatnonzero(wanted[codes])
        rows = np.searchsorted(offsets, at, side="right") - 1
        which = np.searchsorted(number, codes[at])
        pairs = np.unique(which * len(offsets) + rows)
        which, rows = np.divmod(pairs, len(offsets))
        cut = np.searchsorted(which, np.arange(len(number) + 1))
        self.postings = {int(c): rows[cut[i] : cut[i + 1]] for i, c in enumerate(number)}
        self.rows = len(offsets) - 1

    def candidates(self, query: list[list[set[bytes]]]) -> np.ndarray:
        found = np.arange(self.rows)
        for clause in query:
            some = [self._all(grams) for grams in clause]
            found = np.intersect1d(found, np.unique(np.concatenate(some)), assume_unique=True)
        return found

    def _all(self, grams: set[bytes]) -> np.ndarray:
        lists = sorted((self.postings[int.from_bytes(g)] for g in grams), key=len)
        out = lists[0]
        for more in lists[1:]:
            out = np.intersect1d(out, more, assume_unique=True)
        return out


def find_secrets(docs: DataFrame, text: str = "text", key: str = "doc_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rows (key, spans array<struct<kind, start, end>>): the secrets of each row's whole text, by
    start, then in the order of rules; start and end are code points, end exclusive.

    A null or empty text has no spans; a null key is kept; repeated rows each give a row; an empty table gives no
    rows. Other columns are left out, so their names can't clash. Matches of a kind are leftmost and don't overlap.
    """
    schema = T.StructType([docs.schema[key], T.StructField("spans", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))])
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = [trigram_query(r) for r in rules]
        patterns = [r.searched() for r in rules]
        number = np.array(sorted({int.from_bytes(g) for q in queries for clause in q for grams in clause for g in grams}), np.uint32)
        wanted = np.zeros(1 << 24, bool)
        wanted[number] = True
        for batch in batches:
            for part in text_slices(batch, text):
                index = BlockIndex(*utf8(part.column(text)), wanted, number)
                texts = part.column(text)
                spans: list[list] = [[] for _ in range(part.num_rows)]
                for rule, pattern, query in zip(rules, patterns, queries, strict=True):
                    for row in index.candidates(query):
                        value = texts[int(row)].as_py()
                        if value:
                            spans[row] += [(m.start(), rule.kind, m.end()) for m in pattern.finditer(value) if m.end(rule.group) - m.start(rule.group) >= rule.least]
                order = {r.kind: i for i, r in enumerate(rules)}
                rows = [[{"kind": k, "start": s, "end": e} for s, k, e in sorted(x, key=lambda y: (y[0], order[y[1]]))] for x in spans]
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(rows, span_type)], names=[key, "spans"])

    return docs.select(key, text).mapInArrow(scan, schema)


def spans_text(spans: list[dict], kinds: set[str] | None = None) -> str:
    return ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in spans if kinds is None or s["kind"] in kinds)


def base_digest(spans: list[dict], kinds: set[str]) -> str:
    return sha256_hex(spans_text(spans, kinds))
