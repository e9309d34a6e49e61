"""Secret scan with a trigram inverted index.

Every rule is a regular expression. From its parse tree a Boolean query over trigrams is derived that
every matching text must satisfy; the texts of a block are indexed by the trigrams the queries mention;
posting lists are united and intersected, and only the texts left are searched with the expression. A
rule without mandatory trigrams (a run of hexadecimal digits) searches every text of the block.

The index is built per block of rows inside the task that read them: nothing is shuffled, a lost task
is done again on its own, and no source, host or group of copies can fill one task.

Defined cases: a null or empty text has no spans; repeated rows and null ids give one row each; other
columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from re import _constants as op
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from logweave.llm.common import joined_spans, map_batches, sha256, utf8


@dataclass(frozen=True)
class Rule:
    """``group`` of a match needs ``least`` characters, else the match is dropped."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0

    @cached_property
    def regex(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII)

    @cached_property
    def query(self) -> "Query":
        return trigram_query(self.pattern)

    def spans(self, text: str) -> list[tuple[int, int]]:
        found = self.regex.finditer(text)
        return [m.span() for m in found if m.end(self.group) - m.start(self.group) >= self.least]


# fixed values: the expressions of the three base kinds
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]+", 32),
)
# public shapes of other credentials
MORE_RULES = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

# --- from an expression to a query --------------------------------------------------------------

#: ``None`` asks for nothing, a string for one trigram, a pair ("and" | "or", parts) combines queries.
Query = None | str | tuple
_MOST = 64  # strings followed at once; beyond, what is known so far is asked for and the rest begins anew


def both(parts) -> Query:
    parts = [p for p in dict.fromkeys(parts) if p is not None]
    return None if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def either(parts) -> Query:
    parts = list(dict.fromkeys(parts))
    return None if not parts or None in parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_strings(strings: set[str]) -> Query:
    return either(both(s[i : i + 3] for i in range(len(s) - 2)) if len(s) > 2 else None for s in sorted(strings))


def trigram_query(pattern: str) -> Query:
    """A condition on the lower-cased trigrams of every text that ``pattern`` matches."""
    asked: list[Query] = []
    known = _follow(parser.parse(pattern, re.ASCII), {""}, asked)
    return both([*asked, _of_strings(known)])


def _follow(nodes, known: set[str], asked: list[Query]) -> set[str]:
    """Extend the strings ``known`` to end here by ``nodes``; conditions that are settled go to ``asked``."""

    def cut(tail: set[str] = frozenset({""})) -> set[str]:
        asked.append(_of_strings(known))
        return set(tail)

    for kind, value in nodes:
        choices: set[str] | None = None
        if kind is op.LITERAL:
            choices = {chr(value).lower()}
        elif kind is op.IN:
            choices = _members(value)
        elif kind is op.SUBPATTERN:
            known = _follow(value[3], known, asked)
            continue
        elif kind is op.BRANCH:
            ways = []
            for way in value[1]:
                inner: list[Query] = []
                ways.append((_follow(way, {""}, inner), both(inner)))
            if all(q is None for _, q in ways) and all(ways):
                choices = set().union(*(s for s, _ in ways))
            else:
                known = cut()
                asked.append(either(both([q, _of_strings(s)]) for s, q in ways))
                continue
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            least, most, body = value
            inner = []
            once = _follow(body, {""}, inner)
            if (least, most) == (0, 1) and not inner:
                choices = once | {""}
            else:
                known = cut()
                if least:
                    asked.append(both([*inner, _of_strings(once)]))
                continue
        elif kind is op.AT:
            continue
        if choices is None or len(known) * len(choices) > _MOST:
            known = cut(choices if choices is not None and len(choices) <= _MOST else {""})
        else:
            known = {a + b for a in known for b in choices}
    return known


def _members(items) -> set[str] | None:
    out: set[str] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            out.add(chr(value).lower())
        elif kind is op.RANGE and value[1] - value[0] < 8:
            out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 else None


def trigrams_of(query: Query) -> set[str]:
    if query is None or isinstance(query, str):
        return {query} - {None}
    return set().union(*(trigrams_of(part) for part in query[1]))


# --- index and search ----------------------------------------------------------------------------

_LOWER = np.arange(256, dtype=np.int32)
_LOWER[65:91] += 32


class TrigramIndex:
    """Posting lists of the given trigrams over the texts of one block, as bitmaps over its rows."""

    def __init__(self, trigrams):
        self.trigrams = sorted(t for t in trigrams if t.isascii())
        self.number = np.zeros(1 << 24, np.uint8 if len(self.trigrams) < 256 else np.uint16)
        for i, t in enumerate(self.trigrams, 1):
            self.number[(ord(t[0]) << 16) | (ord(t[1]) << 8) | ord(t[2])] = i

    def postings(self, data: np.ndarray, places: np.ndarray) -> dict[str, np.ndarray]:
        found = np.zeros((len(places) - 1, len(self.trigrams) + 1), bool)
        low = _LOWER[data]
        if len(low) > 2:
            number = self.number[(low[:-2] << 16) | (low[1:-1] << 8) | low[2:]]
            at = np.flatnonzero(number)
            row = np.searchsorted(places, at, "right") - 1
            whole = at + 3 <= places[row + 1]  # a trigram must not reach into the next text
            found[row[whole], number[at[whole]]] = True
        return {t: found[:, i] for i, t in enumerate(self.trigrams, 1)}


def candidates(query: Query, postings: dict[str, np.ndarray], n: int) -> np.ndarray:
    """The rows a query leaves, as a bitmap."""
    if query is None:
        return np.ones(n, bool)
    if isinstance(query, str):
        return postings.get(query, np.ones(n, bool))
    combine = np.logical_and if query[0] == "and" else np.logical_or
    return combine.reduce([candidates(part, postings, n) for part in query[1]])


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> DataFrame:
    """``(doc_id, spans array<struct<kind, start, end>>)``, places in code points, ordered by start, then rule."""
    rules = tuple(rules)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = TrigramIndex(set().union(*(trigrams_of(r.query) for r in rules)))
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            texts = batch.column(1)
            postings = index.postings(*utf8(texts))
            found: list[list] = [[] for _ in range(len(texts))]
            for rank, rule in enumerate(rules):
                for i in np.flatnonzero(candidates(rule.query, postings, len(texts))):
                    found[i] += [(s, rank, e) for s, e in rule.spans(texts[int(i)].as_py() or "")]
            spans = [[{"kind": rules[r].kind, "start": s, "end": e} for s, r, e in sorted(row)] for row in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    return map_batches(
        docs.select("doc_id", "text"), scan, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, "
        "spans array<struct<kind:string,start:bigint,end:bigint>>"
    )


def secret_digest(found: DataFrame) -> DataFrame:
    """Counts and a hash of the base spans, and all spans as text, for each row of ``scan_secrets``."""
    base = [r.kind for r in BASE_RULES]

    def digest(batches):
        for batch in batches:
            rows = [[(s["kind"], s["start"], s["end"]) for s in row] for row in batch.column(1).to_pylist()]
            kept = [[s for s in row if s[0] in base] for row in rows]
            counts = [pa.array([sum(s[0] == k for s in row) for row in kept], pa.int64()) for k in base]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array([sha256(joined_spans(r)) for r in kept]), pa.array([joined_spans(r) for r in rows])],
                ["doc_id", *(f"n_{k}" for k in base), "base_sha256", "spans"],
            )

    columns = ", ".join(f"n_{k} bigint" for k in base)
    return map_batches(found, digest, f"doc_id {found.schema['doc_id'].dataType.simpleString()}, {columns}, base_sha256 string, spans string")
