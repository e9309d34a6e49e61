"""Personal data: shapes of entities, and terms that give an entity away.

Base spans are e-mail addresses, IP addresses, payment cards and telephone numbers. A further term is
personal when the corpus shows that it reveals one of these entities. With ``n(c, t)`` the occurrences of
term ``t`` within ``WINDOW`` words of entity ``c``, ``n(t)`` and ``n(c)`` all occurrences and ``N`` the words
of the corpus, the share of the information of ``c`` that ``t`` discloses is

    PMI(c, t) / IC(c) = log(p(c | t) / p(c)) / -log p(c),   p(c | t) = n(c, t) / n(t),   p(c) = n(c) / N.

At ``GENERALISE`` or more the term is replaced by its class, at ``REMOVE`` or more it is removed. A term
counts as evidence only when it stands beside the entity in ``SUPPORT`` different contexts, so that copies
of one text do not make its rare words personal. Counts cover all documents.

Only terms beside entities are counted per pair, and pairs are aggregated before and after the shuffle by
(entity, term, context); the corpus counts are limited to terms with enough support. The disclosing terms
are handed to the tasks only within ``MOST_BYTES``; beyond, occurrences are joined by term.

Defined cases: a null or empty text has no spans; repeated rows give equal rows; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import extended, joined_spans, map_batches, put_back, set_aside, sha256, stored, texts_of

WINDOW = 5
SUPPORT = 5
GENERALISE = 0.95
REMOVE = 0.99
MOST_BYTES = 16 << 20

# fixed values: the expressions of the four base kinds
EMAIL_LEFT = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
EMAIL_RIGHT = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone")
TERM_KINDS = ("generalise", "remove")
_TERM = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
_NO_DIGIT = re.compile(r"[^0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(d - 9 if d > 9 else d for d in (2 * int(x) for x in digits[-2::-2]))) % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """The matches of ``[left]+@right``, found from each ``@``: linear even in long runs without one."""
    seen = 0
    at = text.find("@")
    while at >= 0:
        before = text[seen:at]
        start = seen + len(before.rstrip(EMAIL_LEFT))
        seen = at + 1
        if start < at and (m := EMAIL_RIGHT.match(text, at + 1)):
            seen = m.end()
            yield "email", start, seen
        at = text.find("@", seen)


def _byte(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) < 3 or len(digits) == 3 and int(digits) <= 255


class Covered:
    """Whether a place touches one of the given spans."""

    def __init__(self, spans: list[Span]):
        self.starts, self.ends = [], []
        for start, end in sorted((s, e) for _, s, e in spans):
            if self.ends and start <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def touches(self, start: int, end: int) -> bool:
        i = bisect_right(self.ends, start)
        return i < len(self.starts) and self.starts[i] < end


def base_spans(text: str, mails: bool = True, numbers: bool = True) -> list[Span]:
    """Spans by kind, then start; ``mails`` and ``numbers`` tell which signs the text holds at all."""
    spans: list[Span] = []
    if mails:
        spans += emails(text)
    if numbers:
        spans += [("ip", *m.span()) for m in IP.finditer(text) if all(map(_byte, m[0].split(".")))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(digits := _NO_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
                spans.append(("card", *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(_NO_DIGIT.sub("", m[0])) <= 15:
                    spans.append(("phone", *m.span()))
    return spans


def _rows(texts: pa.Array) -> Iterator[tuple[int, str, list[Span]]]:
    """Row, text and base spans of the rows with any sign of an entity."""
    filled = texts.fill_null("") if texts.null_count else texts
    mails = pc.match_substring(filled, "@").to_pylist()
    numbers = pc.match_substring_regex(filled, "[0-9][^a-zA-Z]*[0-9]").to_pylist()
    for i, (mail, number) in enumerate(zip(mails, numbers)):
        if mail or number:
            text = filled[i].as_py()
            yield i, text, base_spans(text, mail, number)


def entity(kind: str, value: str) -> str:
    """One spelling for one entity."""
    return f"{kind} {value.lower() if kind == 'email' else value if kind == 'ip' else _NO_DIGIT.sub('', value)}"


def _beside(text: str, spans: list[Span]) -> Iterator[tuple[str, list[str]]]:
    """Every entity of a text with the terms around it, entities themselves left out."""
    width = 24 * WINDOW
    taken = Covered(spans)
    for kind, start, end in spans:
        # widened to whole terms; a long run without a space can only make the reach longer
        before = text[max(0, start - width) : start]
        after = text[end : end + width]
        low = max(0, start - width)
        left = [m for m in _TERM.finditer(before) if low == 0 or m.start() > 0]
        right = [m for m in _TERM.finditer(after) if end + width >= len(text) or m.end() < len(after)]
        terms = [(m[0], low + m.start()) for m in left[-WINDOW:]] + [(m[0], end + m.start()) for m in right[:WINDOW]]
        yield entity(kind, text[start:end]), [t.lower() for t, at in terms if not taken.touches(at, at + len(t))]


def entity_contexts(docs: DataFrame) -> DataFrame:
    """``(entity, term, context, n)``: terms beside entities, summed within each batch."""

    def pairs(batches):
        for batch in batches:
            counts: Counter = Counter()
            for _, text, spans in _rows(batch.column(0)):
                for name, terms in _beside(text, spans):
                    context = " ".join(terms)
                    counts.update((name, t, context) for t in {*terms, ""})
            cols = list(zip(*counts)) or [(), (), ()]
            arrays = [pa.array(c, pa.string()) for c in cols]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(counts.values(), pa.int64())], ["entity", "term", "context", "n"])

    found = map_batches(docs.select("text"), pairs, "entity string, term string, context string, n bigint")
    context = F.xxhash64("context").alias("context")
    return found.groupBy("entity", "term", context).agg(F.sum("n").alias("n"))


def term_counts(docs: DataFrame, wanted: set[str] | None) -> DataFrame:
    """``(term, n)`` over all texts; the term ``""`` counts all words. ``None`` counts every term."""

    def count(batches):
        for batch in batches:
            counts: Counter = Counter()
            for text in texts_of(batch.column(0)):
                found = Counter(_TERM.findall(text.lower()))
                counts[""] += found.total()
                counts.update(found if wanted is None else {t: found[t] for t in wanted & found.keys()})
            yield pa.RecordBatch.from_arrays(
                [pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["term", "n"]
            )

    found = map_batches(docs.select("text"), count, "term string, n bigint")
    return found.groupBy("term").agg(F.sum("n").alias("n"))


def _small(terms: DataFrame) -> set[str] | None:
    """The terms as a set, or ``None`` when they are too many to hand out."""
    size = terms.agg(F.sum(F.octet_length("term") + 64)).first()[0] or 0
    return {r["term"] for r in terms.select("term").collect()} if size <= MOST_BYTES else None


def disclosing_terms(docs: DataFrame) -> DataFrame:
    """``(term, share)``: the terms that reveal an entity, with the largest share disclosed of any entity."""
    pairs = stored(entity_contexts(docs))
    entities = pairs.where("term = ''").groupBy("entity").agg(F.sum("n").alias("n_c"))
    strong = stored(
        pairs.where("term <> ''").groupBy("entity", "term").agg(F.sum("n").alias("n_ct"), F.count("*").alias("contexts"))
        .where(F.col("contexts") >= SUPPORT)
    )
    terms = strong.select("term").distinct()
    wanted = _small(terms)
    if wanted is not None and not wanted:
        return strong.selectExpr("term", "cast(0 as double) as share").limit(0)
    counts = stored(term_counts(docs, wanted))
    total = counts.where("term = ''").agg(F.sum("n")).first()[0]
    rows = strong.join(counts, "term").join(entities, "entity")
    p_c = F.col("n_c") / F.lit(float(total))
    share = F.log(F.least(F.col("n_ct") / F.col("n"), F.lit(1.0)) / p_c) / -F.log(p_c)
    return rows.groupBy("term").agg(F.max(share).alias("share")).where(F.col("share") >= GENERALISE)


def _term_spans(text: str, personal: dict[str, str], spans: list[Span]) -> list[Span]:
    low = text.lower()
    if len(low) != len(text) or not personal:  # a letter whose lower case is longer
        low = text
    taken = Covered(spans)
    return [
        (personal[t], *m.span())
        for m in _TERM.finditer(low)
        if (t := m[0].lower()) in personal and not taken.touches(*m.span())
    ]


def find_personal(docs: DataFrame) -> DataFrame:
    """``docs`` with ``pii_spans array<struct<kind, start, end>>``: base kinds as listed, then terms, each by start.

    Columns of ``docs`` stay as they are; a column named ``pii_spans`` is replaced.
    """
    docs = docs.drop("pii_spans")
    terms = stored(disclosing_terms(docs).select("term", F.when(F.col("share") >= REMOVE, "remove").otherwise("generalise").alias("kind")))
    names = _small(terms)
    chosen = None if names is None else {r["term"]: r["kind"] for r in terms.collect()}
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    at = docs.columns.index("text")
    schema = extended(docs, "pii_spans array<struct<kind:string,start:bigint,end:bigint>>")

    def mark(batches):
        for batch in batches:
            rows: list[list[Span]] = [[] for _ in range(batch.num_rows)]
            for i, _, spans in _rows(batch.column(at)):
                rows[i] = spans
            if chosen:
                for i, text in enumerate(texts_of(batch.column(at))):
                    rows[i] = rows[i] + sorted(_term_spans(text, chosen, rows[i]), key=lambda s: (TERM_KINDS.index(s[0]), s[1]))
            spans = pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in row] for row in rows], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, spans], [*batch.schema.names, "pii_spans"])

    marked = map_batches(docs, mark, schema)
    return marked if chosen is not None else _join_terms(marked, terms)


def _join_terms(marked: DataFrame, terms: DataFrame) -> DataFrame:
    """Add the spans of too many terms to hand out: occurrences meet the terms by a join."""
    marked = stored(marked.withColumn("_row", F.xxhash64("text")))

    def occurrences(batches):
        for batch in batches:
            out = []
            for row, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                out += [(row, m[0].lower(), *m.span()) for m in _TERM.finditer(text)]
            cols = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["_row", "term", "start", "end"]
            )

    once = marked.select("_row", "text").dropDuplicates(["_row"])
    found = map_batches(once, occurrences, "_row bigint, term string, start bigint, end bigint").join(terms, "term")
    spans = found.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("kind", "start", "end"))).alias("_more"))
    clear = "filter(coalesce(_more, array()), m -> not exists(pii_spans, s -> s.start < m.end and m.start < s.end))"
    return marked.join(spans, "_row", "left").withColumn("pii_spans", F.concat("pii_spans", F.expr(clear))).drop("_row", "_more")


_CLASS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "remove": ""}


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data replaced by the name of its kind, disclosing terms generalised or removed."""
    columns = docs.columns
    docs, taken = set_aside(docs, "pii_spans", "_row", "_more")
    at = docs.columns.index("text")

    def general(value: str) -> str:
        return "[NUMBER]" if value.isdigit() else "[NAME]" if value[:1].isupper() else "[TERM]"

    def clean(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for i, spans in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if not spans:
                    continue
                out, seen, text = [], 0, texts[i]
                for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
                    if s["start"] >= seen:
                        out += [text[seen : s["start"]], _CLASS.get(s["kind"]) if s["kind"] in _CLASS else general(text[s["start"] : s["end"]])]
                    seen = max(seen, s["end"])
                texts[i] = "".join(out) + text[seen:]
            columns = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns[:-1])]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    found = find_personal(docs)
    return put_back(map_batches(found, clean, docs.schema), taken).select(*columns)


def personal_digest(found: DataFrame) -> DataFrame:
    """Counts and a hash of the base spans, and all spans as text."""

    def digest(batches):
        for batch in batches:
            rows = [[(s["kind"], s["start"], s["end"]) for s in row] for row in batch.column(1).to_pylist()]
            kept = [[s for s in row if s[0] in KINDS] for row in rows]
            counts = [pa.array([sum(s[0] == k for s in row) for row in kept], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array([sha256(joined_spans(r)) for r in kept]), pa.array([joined_spans(r) for r in rows])],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    columns = ", ".join(f"n_{k} bigint" for k in KINDS)
    schema = f"doc_id {found.schema['doc_id'].dataType.simpleString()}, {columns}, base_sha256 string, spans string"
    return map_batches(found.select("doc_id", "pii_spans"), digest, schema)
