"""Substring de-duplication (operator 3): seed and extend.

A repeat of at least ``MIN_WORDS`` words contains a winnowed anchor: of the
``ANCHOR``-word hashes in each window of ``MIN_WORDS`` words the smallest
(the right-most of equal ones) is selected, so equal windows select equal
anchors at equal offsets.  Consecutive windows with one anchor form a run.

1. Seed: anchors that stand in documents of different ids.
2. Extend whole runs: runs of one anchor with equal words on both sides need
   one comparison, with the smallest document that has that run.
3. Extend the rest: where runs of an anchor differ, every window of one run
   of each kind is compared by the words left and right of its anchor, and
   what it loses every run of that kind in the same document loses.

No step forms pairs of documents: every comparison is a minimum over equal
keys, aggregated before the shuffle.  Covered words are merged into maximal
spans and removed; each window is judged on the input.

Defined results: a null or blank text has no words and is kept as an empty
text.  A row with a null id keeps all its words and removes none elsewhere.
Rows with one id never remove each other's words; repeated rows give repeated
results.  An empty table gives an empty
result.  Texts are read whole; keys are 128 bits wide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import broadcast_if_light, broadcast_if_small, write_table

MIN_WORDS, ANCHOR = 50, 25


def _selected(g: np.ndarray, width: int) -> np.ndarray:
    """Right-most place of the smallest value in each ``width`` neighbours."""
    at, span = np.arange(len(g)), 1
    smaller = lambda a, b: np.where(g[a] < g[b], a, b)
    while 2 * span <= width:
        at = smaller(at[:-span], at[span:])
        span *= 2
    n = len(g) - width + 1
    return smaller(at[:n], at[width - span:width - span + n])


def _runs(text: str, size: int, anchor: int):
    """(anchor hash, place of the anchor in the run, first window, number of
    windows, hash of all words of the run) as arrays."""
    h = W.hashes(W.split(text))
    if len(h) < size:
        return None
    r, n = W.Rolling(h), len(h) - anchor + 1
    g = r.runs(np.arange(n), np.arange(anchor, len(h) + 1))
    at = _selected(g, size - anchor + 1)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    count = np.diff(np.r_[first, len(at)])
    return g[at[first]], at[first] - first, first, count, r.runs(first, first + count - 1 + size)


_RUN = pa.schema([("a", pa.int64()), ("off", pa.int32()), ("first", pa.int32()), ("n", pa.int32()), ("around", pa.int64()),
                  ("doc", pa.int64()), ("h", pa.int32())])


def _run_table(docs: DataFrame, size: int, anchor: int) -> DataFrame:
    def scan(batches):
        for b in batches:
            cols: list[list] = [[] for _ in _RUN]
            for doc, h, text in zip(*b.columns):
                runs = _runs(text.as_py(), size, anchor)
                if runs is not None:
                    a, off, first, n, around = runs
                    for c, x in zip(cols, (a.view(np.int64), off, first, n, around.view(np.int64),
                                           np.full(len(a), doc.as_py()), np.full(len(a), h.as_py()))):
                        c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(f.type.to_pandas_dtype()) if c else [], f.type)
                                              for c, f in zip(cols, _RUN)], schema=_RUN)
    return docs.mapInArrow(scan, "a long, off int, first int, n int, around long, doc long, h int")


def _windows(size: int):
    """arrow_udf: windows of the listed runs, as (a, off, w, t): off places of
    the anchor before, w the hash of all words, t the window."""
    kind = pa.list_(pa.struct([("a", pa.int64()), ("off", pa.int32()), ("w", pa.int64()), ("t", pa.int32())]))

    @F.arrow_udf("array<struct<a:bigint,off:int,w:bigint,t:int>>")
    def windows(texts: pa.Array, runs: pa.Array) -> pa.Array:
        out = []
        for text, some in zip(texts, runs):
            r = W.Rolling(W.hashes(W.split(text.as_py())))
            rows = []
            for x in some.as_py():
                t = np.arange(x["first"], x["first"] + x["n"])
                w = r.runs(t, t + size).view(np.int64)
                rows += [{"a": x["a"], "off": x["first"] + x["off"] - int(i), "w": int(v), "t": int(i)} for i, v in zip(t, w)]
            out.append(rows)
        return pa.array(out, kind)

    return windows


def repeated_spans(docs: DataFrame, size: int = MIN_WORDS, anchor: int = ANCHOR) -> DataFrame:
    """(doc, h, text) -> (doc, h, spans): per text the maximal word ranges
    [start, end) that repeat in a smaller document id, sorted."""
    runs = write_table(_run_table(docs, size, anchor), "substring-runs")
    seeds = write_table(runs.groupBy("a").agg(F.min("doc").alias("low"), F.max("doc").alias("high"))
                        .where(F.col("low") < F.col("high")).select("a", "low"), "substring-seeds")
    shared = write_table(runs.join(seeds, "a").drop("low"), "substring-shared")

    key = ["a", "off", "n", "around"]
    kinds = write_table(shared.groupBy(*key).agg(F.min(F.struct("doc", "h", "first")).alias("low")), "substring-kinds")
    whole = (shared.join(kinds, key).where(F.col("doc") > F.col("low.doc"))
             .select("doc", "h", F.col("first").alias("start"), (F.col("first") + F.col("n") - 1 + size).alias("end")))

    # Anchors whose runs differ: one run of each kind is opened window by window.
    mixed = kinds.groupBy("a").agg(F.count(F.lit(1)).alias("kinds"), F.min("low.doc").alias("l"), F.max("low.doc").alias("u"))
    opened = (kinds.join(write_table(mixed.where((F.col("kinds") > 1) & (F.col("l") < F.col("u"))).select("a"), "substring-mixed"), "a")
              .groupBy(F.col("low.doc").alias("doc"), F.col("low.h").alias("h"))
              .agg(F.collect_list(F.struct("a", "off", F.col("low.first").alias("first"), "n")).alias("runs")))
    opened = write_table(opened, "substring-opened")
    cut = docs.join(broadcast_if_light(opened, "runs"), ["doc", "h"])
    windows = write_table(cut.select("doc", "h", F.explode(_windows(size)(F.col("text"), F.col("runs"))).alias("x")).select("doc", "h", "x.*"),
                          "substring-windows")
    lowest = write_table(windows.groupBy("a", "off", "w").agg(F.min("doc").alias("low"), F.max("doc").alias("high"))
                         .where(F.col("low") < F.col("high")).drop("high"), "substring-lowest")
    # All windows of a run hold its anchor, so its removed windows cover one range.
    place = (F.col("t") + F.col("off")).alias("place")
    cut_runs = (windows.join(lowest, ["a", "off", "w"]).where(F.col("doc") > F.col("low"))
                .groupBy("a", "doc", "h", place).agg(F.min("t").alias("t"), F.max("t").alias("u")))
    cut_runs = write_table(cut_runs, "substring-cut").withColumnsRenamed({"a": "c_a", "doc": "c_doc", "h": "c_h"})

    # The range, counted from the run's first window, holds for every run of
    # that kind in the smallest document; in the others such runs go whole.
    cut_kinds = kinds.join(broadcast_if_small(cut_runs), (F.col("a") == F.col("c_a")) & (F.col("low.doc") == F.col("c_doc"))
                           & (F.col("low.h") == F.col("c_h")) & (F.col("low.first") + F.col("off") == F.col("place")))
    cut_kinds = write_table(cut_kinds.select(*key, F.col("c_doc").alias("doc"), (F.col("t") - F.col("low.first")).alias("t"),
                                             (F.col("u") - F.col("low.first")).alias("u")), "substring-cut-kinds")
    single = (shared.join(broadcast_if_small(cut_kinds), [*key, "doc"])
              .select("doc", "h", (F.col("first") + F.col("t")).alias("start"), (F.col("first") + F.col("u") + size).alias("end")))

    # A text has at most one range a word, so a list of them is of its size.
    ranges = whole.unionByName(single).groupBy("doc", "h").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("r"))
    return write_table(ranges.select("doc", "h", _merged(F.col("r")).alias("spans")), "substring-spans")


def _merged(ranges):
    """Sorted ranges merged where they meet."""
    @F.arrow_udf("array<struct<start:int,end:int>>")
    def merged(a: pa.Array) -> pa.Array:
        out = []
        for some in a:
            spans: list = []
            for x in some.as_py():
                if spans and x["start"] <= spans[-1]["end"]:
                    spans[-1]["end"] = max(spans[-1]["end"], x["end"])
                else:
                    spans.append(x)
            out.append(spans)
        return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))

    return merged(ranges)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = MIN_WORDS,
                   anchor: int = ANCHOR) -> DataFrame:
    """Per row: doc_id, spans (word ranges removed), n_words, n_removed and
    kept, the remaining words joined by one space."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.hash("text"))
    spans = repeated_spans(rows.where(F.col("doc").isNotNull()).select("doc", "h", "text"), size, anchor)

    @F.arrow_udf("struct<n_words:bigint,n_removed:bigint,kept:string>")
    def kept(texts: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        for text, some in zip(texts, found):
            words = W.split(text.as_py())
            n, parts, at = len(words), [], 0
            for x in some.as_py() or ():
                parts += words[at:x["start"]]
                at = x["end"]
            parts += words[at:]
            out.append({"n_words": n, "n_removed": n - len(parts), "kept": b" ".join(parts).decode()})
        return pa.array(out, pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())]))

    # Null ids meet nothing; they are spread by their text.
    found = broadcast_if_light(spans, "spans").withColumnsRenamed({"doc": "s_doc", "h": "s_h"})
    j = rows.join(found, (F.col("doc") == F.col("s_doc")) & (F.col("h") == F.col("s_h")), "left")
    return (j.withColumn("k", kept(F.col("text"), F.col("spans")))
            .select(F.col("doc").alias("doc_id"), "spans", "k.n_words", "k.n_removed", "k.kept"))
