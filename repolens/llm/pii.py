"""Personal data (operator 10).

Base detection finds emails, IP addresses, card and phone numbers.  Corpus
co-occurrence then tells which further terms reveal one of these protected
values: with document frequencies n(t), n(v) and n(t, v), t within a few
words of v, the point-wise mutual information log(N n(t, v) / (n(t) n(v)))
over the value's information content log(N / n(v)) is the share of the value
that the term discloses.  Terms seen near the value in several different
surroundings, at or above the disclosure threshold, become spans wherever
they stand: of kind ``strong``, to be removed, if they disclose nearly all of
the value, else of kind ``term``, to be generalised to a category mark.

Defined results: a null text is an empty one and has no spans (its sanitised
text is null).  Repeated rows count once per row as documents, but copies of
one surrounding count once as support, so groups of copies alone make no
term.  Texts are scanned whole, in time linear in their length.  An empty
table gives an empty result.  Other columns pass through; only the ``spans`` of
``find_spans`` replace a column of that name.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, is_small, write_table

BASE_KINDS = ("email", "ip", "card", "phone")
#: ``term``: a revealing term to generalise; ``strong``: one to remove.
KINDS = (*BASE_KINDS, "term", "strong")
#: Words on either side of a value that count as near it; different
#: surroundings that a term needs; disclosure from which a term is a span,
#: and from which it is removed instead of generalised.
NEAR_WORDS, MIN_SUPPORT, DISCLOSES, REMOVES = 8, 3, 0.9, 0.999
SPAN_TYPE = "array<struct<kind:string,start:int,end:int>>"

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")  # always matches a whole chain: linear
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W\d_]{3,}")
_LUHN = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
_FLUSH = 200_000


def _emails(text: str):
    """The only possible start for an ``@`` is the run of local characters
    before it, back to the previous match."""
    done, at = 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at)
        if m:
            start = at
            while start > done and text[start - 1] in _LOCAL_CHARS:
                start -= 1
            if start < at:
                yield start, m.end()
                done = m.end()
        at = text.find("@", at + 1)


def _ips(text: str):
    """Chains of numbers are cut into fours from the left."""
    for m in _NUMBERS.finditer(text):
        if m.end() - m.start() < 7:
            continue
        parts, start = m.group().split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k:k + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:4] or 0) <= 255 for p in four):
                yield start, start + size
            start += size + 1


def _cards(text: str):
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() < 13:
            continue
        digits = [int(c) for c in m.group() if c.isdigit()]
        if 13 <= len(digits) <= 19 and (sum(digits[-1::-2]) + sum(_LUHN[d] for d in digits[-2::-2])) % 10 == 0:
            yield m.span()


def _phones(text: str):
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                yield m.span()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as listed, then start."""
    return [(k, a, b) for k, find in zip(BASE_KINDS, (_emails, _ips, _cards, _phones)) for a, b in find(text)]


def _near(text: str, a: int, b: int, span: int = 400) -> tuple[list[str], list[str]]:
    """Up to NEAR_WORDS terms before and after a value.  The window of
    characters doubles until it holds them or the text ends."""
    while True:
        lo, hi = max(0, a - span), min(len(text), b + span)
        before, after = _TERM.findall(text[lo:a].lower()), _TERM.findall(text[b:hi].lower())
        if (len(before) > NEAR_WORDS or not lo) and (len(after) > NEAR_WORDS or hi == len(text)):
            return before[-NEAR_WORDS:], after[:NEAR_WORDS]
        span *= 2


def _contexts(batches):
    """Rows (value, term, context, doc): a term near a value in a document
    (doc is a number within the task), context a hash of the surroundings;
    one row with an empty term per document and value."""
    doc = 0
    for batch in batches:
        rows = []
        for s in batch.column(0):
            text = s.as_py()
            doc += 1
            seen = set()
            for kind, a, b in base_spans(text) if text else ():
                value = f"{kind}:{text[a:b].lower()}"
                before, after = _near(text, a, b)
                context = xxhash.xxh3_64_intdigest("\n".join([*before, "", *after])) - (1 << 63)
                seen.update((value, t, context) for t in {*before, *after})
                seen.add((value, "", context))
            # one row per document, value and term; its smallest context stands for it
            first: dict = {}
            for value, t, context in seen:
                first[value, t] = min(context, first.get((value, t), context))
            rows += [(v, t, c) for (v, t), c in first.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], y) for k, y in enumerate((pa.string(), pa.string(), pa.int64()))],
                                         names=["value", "term", "context"])


def _frequencies(batches):
    """Rows (term, docs): in how many of the task's documents a term stands;
    summed before the shuffle, flushed at a fixed number of terms."""
    counts: Counter = Counter()

    def rows():
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
                                          names=["term", "docs"])
    for batch in batches:
        for s in batch.column(0):
            counts.update(set(_TERM.findall((s.as_py() or "").lower())))
        if len(counts) > _FLUSH:
            yield rows()
            counts.clear()
    yield rows()


def revealing_terms(docs: DataFrame, text_col: str = "text", discloses: float = DISCLOSES,
                    min_support: int = MIN_SUPPORT) -> DataFrame:
    """(value, term, docs, support, disclosure) of the terms that disclose a
    protected value, counted over all documents."""
    texts = docs.select(F.col(text_col).alias("text"))
    near = (texts.mapInArrow(_contexts, "value string, term string, context long")
            .groupBy("value", "term", "context").agg(F.count(F.lit(1)).alias("n"))
            .groupBy("value", "term").agg(F.sum("n").alias("docs"), F.count(F.lit(1)).alias("support")))
    near = write_table(near.where((F.col("support") >= min_support) | (F.col("term") == "")), "pii-near")
    pairs = near.where(F.col("term") != "")
    if not pairs.limit(1).count():
        return pairs.select("value", "term", "docs", "support", F.lit(None).cast("double").alias("disclosure")).where(F.lit(False))
    values = near.where(F.col("term") == "").select("value", F.col("docs").alias("value_docs"))
    df = (texts.mapInArrow(_frequencies, "term string, docs long").groupBy("term").agg(F.sum("docs").alias("term_docs"))
          .join(pairs.select("term").distinct(), "term"))
    total = F.lit(math.log(max(texts.count(), 2)))
    gain = total + F.log("docs") - F.log("term_docs") - F.log("value_docs")
    content = total - F.log("value_docs")
    return (pairs.join(values, "value").join(df, "term")
            .withColumn("disclosure", F.when(content > 0, F.least(gain / content, F.lit(1.0))).otherwise(0.0))
            .where(F.col("disclosure") >= discloses).select("value", "term", "docs", "support", "disclosure"))


def _all_spans(text: str, terms) -> list[tuple[str, int, int]]:
    """Base spans, then the terms outside them.  Positions count in ``text``
    itself, so each word is lower-cased by itself."""
    base = base_spans(text)
    if not terms:
        return base
    taken = sorted((a, b) for _, a, b in base)
    starts, ends = [a for a, _ in taken], sorted(b for _, b in taken)
    free = lambda a, b: bisect_left(starts, b) == bisect_right(ends, a)
    found = [(terms[m.group().lower()], *m.span()) for m in _TERM.finditer(text) if m.group().lower() in terms and free(*m.span())]
    return base + sorted(found, key=lambda x: KINDS.index(x[0]))


def _span_array(found: list) -> pa.Array:
    kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    return pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in spans] for spans in found], pa.list_(kind))


def _present(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(h1, h2, here): the revealing terms of each distinct text that has any,
    by a join; for term lists that may not be broadcast."""
    def words(batches):
        for batch in batches:
            rows = [(h1.as_py(), h2.as_py(), w) for h1, h2, s in zip(*batch.columns) for w in set(_TERM.findall((s.as_py() or "").lower()))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], y) for k, y in enumerate((pa.int64(), pa.int64(), pa.string()))],
                                             names=["h1", "h2", "term"])
    return (texts.mapInArrow(words, "h1 long, h2 long, term string").join(terms, "term").dropDuplicates()
            .groupBy("h1", "h2").agg(F.map_from_entries(F.collect_list(F.struct("term", "kind"))).alias("here")))


def _with_spans(docs: DataFrame, terms: DataFrame, text_col: str, max_broadcast: int, out: str, kind: str, result) -> DataFrame:
    """``docs`` with the column ``out``: ``result(texts, spans)``, made in the
    Python call that finds the spans (a second one would need a second worker
    beside the first for every task)."""
    text, listed = F.col(text_col), (
        terms.groupBy("term").agg(F.when(F.max("disclosure") >= REMOVES, "strong").otherwise("term").alias("kind")))
    if is_small(listed, max_broadcast):
        known = docs.sparkSession.sparkContext.broadcast({r[0]: r[1] for r in listed.collect()})

        @F.arrow_udf(kind)
        def judged(a: pa.Array) -> pa.Array:
            texts = a.to_pylist()
            return result(texts, [_all_spans(s or "", known.value) for s in texts])

        return docs.withColumn(out, judged(text))

    @F.arrow_udf(kind)
    def joined(a: pa.Array, here: pa.Array) -> pa.Array:
        texts = a.to_pylist()
        return result(texts, [_all_spans(s or "", dict(h.as_py() or ())) for s, h in zip(texts, here)])

    whole = F.coalesce(text, F.lit(""))
    keys = [F.xxhash64(whole).alias("h1"), F.xxhash64(F.lit(1), whole).alias("h2")]
    here = _present(docs.select(*keys, whole).distinct(), listed).select(F.col("h1").alias("__h1"), F.col("h2").alias("__h2"), F.col("here").alias("__here"))
    found = docs.join(here, (keys[0] == F.col("__h1")) & (keys[1] == F.col("__h2")), "left")
    return found.withColumn(out, joined(text, F.col("__here"))).select(*[c for c in docs.columns if c != out], out)


def find_spans(docs: DataFrame, terms: DataFrame, text_col: str = "text", max_broadcast: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` with ``spans``: base spans and revealing terms, by kind as in
    KINDS, then start.  Up to ``max_broadcast`` terms (counted) go to every
    task; a longer list is joined to the texts by their words."""
    return _with_spans(docs, terms, text_col, max_broadcast, "spans", SPAN_TYPE, lambda texts, found: _span_array(found))


def _cleaned(texts: list, found: list) -> pa.Array:
    """Texts without their spans; a null text stays null."""
    out = []
    for text, spans in zip(texts, found):
        if text is None:
            out.append(None)
            continue
        at, parts = 0, []
        for kind, start, end in sorted(spans, key=lambda x: (x[1], -x[2])):
            if start >= at:
                parts += [text[at:start], "" if kind == "strong" else f"[{kind.upper()}]"]
            at = max(at, end)
        out.append("".join([*parts, text[at:]]) if at else text)
    return pa.array(out, pa.string())


def span_string(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def sanitise(docs: DataFrame, text_col: str = "text", terms: DataFrame | None = None, max_broadcast: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` with the text sanitised: ``strong`` spans go, all others become
    ``[KIND]``.  Overlapping spans are replaced as one, named by the first.
    All other columns stay as they are, whatever their names."""
    terms = write_table(revealing_terms(docs, text_col), "pii-terms") if terms is None else terms
    # The row travels as one struct, so no column of it can clash.
    rows = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))
    found = _with_spans(rows, terms, "text", max_broadcast, "clean", "string", _cleaned)
    return found.select(*[(F.col("clean") if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])
