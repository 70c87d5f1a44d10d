"""Ranked lexical search with per-term geometric blocking (operator 13).

Documents are tokenised once into forward lists over the queries' vocabulary
and dealt by a similarity code into segments of bounded size.  In a segment
every term has a posting list, and each list is cut into blocks of similar
documents: members go to the nearest of some evenly spaced members, by the
inner product of weighted random projections.  A block stores the
coordinatewise maximum of its documents.  A query goes through its terms'
lists, heaviest first; a block is skipped only if the query's product with
that maximum is below the score of the worst result so far, and lists are left
out only when all of them together cannot reach that score.  Opened documents
get their exact score.  So the results are those of scoring all documents.

Lists of few members need no blocks (their documents are opened), and a list
that holds more than a quarter of its segment is one block: its bound is that
of the whole segment, the largest values of the lists, which is looked at
before any list is.

Defined results: a null or empty text has no term and is no result; terms of a
query count as often as they stand in it; an item without terms has no rows;
repeated items and documents count one by one, null ids come last.  Only the
named columns are read.  Empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import write_table

#: Documents and entries that a segment holds at most (one document always fits).
SEGMENT_DOCS, SEGMENT_ENTRIES = 4096, 1 << 20
#: Lists shorter than SHORT are opened; blocks have some BLOCK members, a list
#: has at most BLOCKS of them; numbers of a projection.
SHORT, BLOCK, BLOCKS, SKETCH = 256, 256, 8, 32
#: Query terms that are searched together (queries come in blocks of items).
QUERY_TERMS = 200_000
#: One segment in so many is searched first, for the first thresholds.
SEEDS_ONE_IN = 16
#: Fixed values of the ranking formula.
K, B, SCALE = 12, 25, 1_000_000_000

_TERM = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_NO_ID = (1 << 63) - 1

INDEX_SCHEMA = ("docs array<bigint>, starts array<int>, terms array<int>, value array<int>, list_term array<int>, list_start array<int>, "
                "members array<int>, block_list array<int>, block_start array<int>, sum_start array<int>, sum_term array<int>, sum_max array<int>")


def terms(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits and non-ASCII characters, A-Z lower-cased."""
    return (text or "").encode().translate(_TERM).split()


def _runs(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers of [start, end) of each pair, one after another."""
    size = ends - starts
    to = np.cumsum(size)
    return np.repeat(ends - to, size) + np.arange(to[-1] if len(to) else 0)


def _item_terms(batches):
    """(item, term, n) of each item."""
    for batch in batches:
        rows = [(i, t, n) for i, text in zip(*(c.to_pylist() for c in batch.columns)) for t, n in Counter(terms(text)).items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1].decode() for r in rows], pa.string()),
                                          pa.array([r[2] for r in rows], pa.int64())], names=["item", "term", "n"])


def _forward(vocabulary):
    """Rows (doc_id, text) -> (doc_id, n, code, terms, tf): number of terms,
    similarity code and the counts of vocabulary terms; texts without any term
    are left out."""
    def run(batches):
        ids = {t.encode(): i for i, t in enumerate(vocabulary.value)}
        # A code bit is the sign of a sum of random signs, one of each term.
        signs = np.random.default_rng(13).integers(0, 2, (len(ids), SKETCH), dtype=np.int8) * 2 - 1
        bits = 1 << np.arange(SKETCH, dtype=np.int64)[::-1]
        for batch in batches:
            out = [], [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = terms(text.as_py())
                if not words:
                    continue
                at = np.fromiter(map(ids.get, words, repeat(-1)), np.int32, len(words))
                t, n = np.unique(at[at >= 0], return_counts=True)
                code = int(((signs[t].sum(axis=0, dtype=np.int64) > 0) * bits).sum())
                for column, x in zip(out, (doc, len(words), code, t.astype(np.int32), n.astype(np.int32))):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()),
                                              _lists(out[3]), _lists(out[4])], names=["doc_id", "n", "code", "terms", "tf"])
    return run


def _lists(arrays: list[np.ndarray], kind=np.int32) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, arrays)]).astype(np.int32), pa.array(np.concatenate([*arrays, np.empty(0, kind)]).astype(kind)))


def _holders(batches):
    """(term, df) over the task's rows."""
    total = np.zeros(0, np.int64)
    for batch in batches:
        n = np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False))
        if len(n) > len(total):
            total = np.concatenate([total, np.zeros(len(n) - len(total), np.int64)])
        total[:len(n)] += n
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["term", "df"])


def build_segment(docs: list, rows_terms: list[np.ndarray], rows_value: list[np.ndarray], weight: np.ndarray) -> pa.RecordBatch:
    """One row of INDEX_SCHEMA: forward lists, posting lists, blocks, maxima."""
    size, n_terms = np.array([len(t) for t in rows_terms]), len(weight)
    starts, term, value = np.concatenate([[0], np.cumsum(size)]), np.concatenate(rows_terms), np.concatenate(rows_value)
    owner = np.repeat(np.arange(len(docs)), size)
    # Projections of the weighted documents, of unit length.
    signs = np.random.default_rng(31).integers(0, 2, (n_terms, SKETCH)).astype(np.float32) * 2 - 1
    sketch = np.add.reduceat(signs[term] * (weight[term] * value.astype(np.float64)).astype(np.float32)[:, None], starts[:-1], axis=0)
    sketch /= np.maximum(np.linalg.norm(sketch, axis=1, keepdims=True), 1e-9)
    order = np.argsort(term, kind="stable")
    members = owner[order]
    list_term, list_start = np.unique(term[order], return_index=True)
    list_end = np.append(list_start[1:], len(members))
    block_list, block_start, sums = [], [], []
    for k, (lo, hi) in enumerate(zip(list_start.tolist(), list_end.tolist())):
        n = hi - lo
        if n < SHORT or 4 * n > len(docs):
            continue
        block_list.append(k)
        block_start.append(lo)
        here = members[lo:hi]
        heads = here[np.linspace(0, n - 1, min(BLOCKS, -(-n // BLOCK))).astype(int)]
        near = (sketch[here] @ sketch[heads].T).argmax(axis=1)
        by = np.argsort(near, kind="stable")
        members[lo:hi] = here = here[by]
        cuts = np.flatnonzero(np.diff(near[by])) + 1
        block_list += [k] * len(cuts)
        block_start += (lo + cuts).tolist()
        block = np.repeat(np.arange(len(cuts) + 1), np.diff([0, *cuts.tolist(), n]))
        most, width = np.zeros((len(cuts) + 1, n_terms), np.int32), size[here]
        at = _runs(starts[here], starts[here] + width)
        np.maximum.at(most, (np.repeat(block, width), term[at]), value[at])
        for row in most:
            held = np.flatnonzero(row)
            sums.append((held, row[held]))
    sum_start = np.concatenate([[0], np.cumsum([len(t) for t, _ in sums])])
    flat = lambda x: np.concatenate([*x, np.empty(0, np.int32)])
    columns = [docs, starts, term, value, list_term, np.append(list_start, len(members)), members, block_list, block_start,
               sum_start, flat([t for t, _ in sums]), flat([m for _, m in sums])]
    kinds = [pa.int64(), *[pa.int32()] * 11]
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), pa.array(c, kind) if isinstance(c, list) else pa.array(c.astype(np.int32)))
                                       for c, kind in zip(columns, kinds)], names=[f.split()[0] for f in INDEX_SCHEMA.split(", ")])


def _segments(weight, n_docs: int, n_words: int):
    """Sorted rows (doc_id, n, terms, tf) to segments; a value is the part of
    a term's score that its weight multiplies."""
    def run(batches):
        docs, rows_terms, rows_value, held = [], [], [], 0
        for batch in batches:
            n = batch.column(1).to_numpy()
            m = 100 - B + (B * n * n_docs) // n_words
            for doc, one, t, tf in zip(batch.column(0).to_pylist(), m.tolist(), batch.column(2), batch.column(3)):
                t, tf = t.values.to_numpy(zero_copy_only=False), tf.values.to_numpy(zero_copy_only=False).astype(np.int64)
                docs.append(doc)
                rows_terms.append(t)
                rows_value.append(((SCALE * tf) // (1000 * tf + K * one)).astype(np.int32))
                held += len(t)
                if len(docs) >= SEGMENT_DOCS or held >= SEGMENT_ENTRIES:
                    yield build_segment(docs, rows_terms, rows_value, weight.value)
                    docs, rows_terms, rows_value, held = [], [], [], 0
        if docs:
            yield build_segment(docs, rows_terms, rows_value, weight.value)
    return run


class Segment:
    """A row of the index, as arrays."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        (docs, self.starts, self.term, self.value, list_term, self.list_start, self.members, block_list, self.block_start,
         self.sum_start, self.sum_term, self.sum_max) = (c[row].values for c in batch.columns)
        self.docs = docs.fill_null(_NO_ID).to_numpy(zero_copy_only=False)
        for name in ("starts", "term", "value", "list_start", "members", "block_start", "sum_start", "sum_term", "sum_max"):
            setattr(self, name, getattr(self, name).to_numpy(zero_copy_only=False).astype(np.int64))
        self.list_of = {t: k for k, t in enumerate(list_term.to_pylist())}
        lists = block_list.to_numpy(zero_copy_only=False)
        self.first_block = np.searchsorted(lists, np.arange(len(self.list_of) + 1))
        self.block_end = np.append(self.block_start[1:], 0)
        last = self.first_block[1:][np.diff(self.first_block) > 0] - 1
        self.block_end[last] = self.list_start[1:][np.diff(self.first_block) > 0]
        # The largest value of each list.
        sorted_values = self.value[np.argsort(self.term, kind="stable")]
        self.top = np.maximum.reduceat(sorted_values, self.list_start[:-1]) if len(self.list_of) else np.empty(0, np.int64)

    def _products(self, query: np.ndarray, start: np.ndarray, end: np.ndarray, term: np.ndarray, value: np.ndarray) -> np.ndarray:
        at = _runs(start, end)
        return np.add.reduceat(query[term[at]] * value[at], np.concatenate([[0], np.cumsum(end - start)[:-1]]))

    def search(self, query: np.ndarray, held: list[int], least: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """The k best (doc ids, scores) above 0 and not below ``least``, and
        the number of documents opened.  ``query`` has the weight of each
        term, ``held`` the terms it has."""
        lists = [self.list_of[t] for t in held if t in self.list_of and query[t]]
        most = sorted(((int(query[t] * self.top[self.list_of[t]]), self.list_of[t]) for t in held if t in self.list_of), reverse=True)
        rest, seen, opened = sum(x for x, _ in most), np.zeros(len(self.docs), bool), 0
        ids, scores, least = np.empty(0, np.int64), np.empty(0, np.int64), max(least, 1)
        for bound, one in most if lists else ():
            if rest < least:
                break
            rest -= bound
            a, b = self.first_block[one], self.first_block[one + 1]
            if a == b:
                found = self.members[self.list_start[one]:self.list_start[one + 1]]
            else:
                bounds = self._products(query, self.sum_start[a:b], self.sum_start[a + 1:b + 1], self.sum_term, self.sum_max)
                keep = np.flatnonzero(bounds >= least) + a
                found = self.members[_runs(self.block_start[keep], self.block_end[keep])]
            found = found[~seen[found]]
            if not len(found):
                continue
            seen[found] = True
            opened += len(found)
            got = self._products(query, self.starts[found], self.starts[found + 1], self.term, self.value)
            ids, scores = np.concatenate([ids, self.docs[found]]), np.concatenate([scores, got])
            keep = np.flatnonzero(scores >= least)
            keep = keep[np.lexsort((ids[keep], -scores[keep]))[:k]]
            ids, scores = ids[keep], scores[keep]
            if len(ids) == k:
                least = int(scores[-1])
        return ids, scores, opened


def _search(queries, k: int):
    """Index rows to (item, doc_id, score, opened): each segment's k best."""
    def run(batches):
        n_terms, items = queries.value
        query = np.zeros(n_terms, np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                segment, out = Segment(batch, row), []
                for item, held, weights, least in items:
                    query[held] = weights
                    ids, scores, opened = segment.search(query, held, least, k)
                    out += [(item, None if d == _NO_ID else d, s, opened) for d, s in zip(ids.tolist(), scores.tolist())]
                    query[held] = 0
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(4)], names=["item", "doc_id", "score", "opened"])
    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    first = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)


def build_index(docs: DataFrame, vocabulary: list[str]) -> tuple[DataFrame, np.ndarray]:
    """The index of (doc_id, text) rows over some terms, and the terms' weights.
    Counts are those of all documents."""
    spark = docs.sparkSession
    forward = write_table(docs.select("doc_id", "text").mapInArrow(_forward(spark.sparkContext.broadcast(vocabulary)), "doc_id long, n long, code long, terms array<int>, tf array<int>"), "lexical-forward")
    n_docs, n_words = forward.agg(F.count(F.lit(1)), F.sum("n")).first()
    df = np.zeros(len(vocabulary), np.int64)
    for t, n in forward.select("terms").mapInArrow(_holders, "term int, df long").groupBy("term").agg(F.sum("df")).collect():
        df[t] = n
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(n) + 1))) for n in df], np.int64)
    shared = spark.sparkContext.broadcast(weight)
    dealt = forward.where(F.size("terms") > 0).repartitionByRange("code", "doc_id", "n").sortWithinPartitions("code", "doc_id")
    return write_table(dealt.select("doc_id", "n", "terms", "tf").mapInArrow(_segments(shared, n_docs or 0, n_words or 1), INDEX_SCHEMA), "lexical-index",
                       **{"parquet.block.row.count.limit": 1}), weight  # a segment has megabytes: readers take one at a time


def search_index(index: DataFrame, weight: np.ndarray, queries: list[tuple[int, list[int], list[int]]], k: int = 20) -> DataFrame:
    """(item, doc_id, score, opened, rank) of (item, term ids, counts) queries."""
    spark = index.sparkSession
    schema = "item long, doc_id long, score long, opened long"

    def run(segments, least):
        items = [(i, t, (weight[t] * np.array(n, np.int64)).tolist(), least.get(i, 0)) for i, t, n in queries]
        return segments.mapInArrow(_search(spark.sparkContext.broadcast((len(weight), items)), k), schema)

    least = {}
    if index.count() > SEEDS_ONE_IN:
        seeds = index.where(F.pmod(F.xxhash64("docs"), F.lit(SEEDS_ONE_IN)) == 0)
        least = {r["item"]: r["score"] for r in _best(run(seeds, {}), k).where(F.col("rank") == k).collect()}
    return _best(run(index, least), k)


def search(docs: DataFrame, items: DataFrame, item_col: str = "item_id", text_col: str = "text", k: int = 20) -> DataFrame:
    """Each item's k best documents: item id, rank, doc_id, score."""
    spark = docs.sparkSession
    numbered = write_table(items.select(F.monotonically_increasing_id().alias("item"), F.col(item_col).alias("item_id"), F.col(text_col).alias("text")), "lexical-items")
    asked = write_table(numbered.select("item", "text").mapInArrow(_item_terms, "item long, term string, n long"), "lexical-queries")
    blocks = -(-asked.count() // QUERY_TERMS)
    out = spark.createDataFrame([], "item long, doc_id long, score long, opened long, rank int")
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).toArrow().to_pylist()
        vocabulary = sorted({r["term"] for r in rows})
        ids, queries = {t: i for i, t in enumerate(vocabulary)}, {}
        for r in rows:
            t, n = queries.setdefault(r["item"], ([], []))
            t.append(ids[r["term"]])
            n.append(r["n"])
        index, weight = build_index(docs, vocabulary)
        out = out.unionByName(write_table(search_index(index, weight, [(i, t, n) for i, (t, n) in queries.items()], k), "lexical-found"))
    return out.join(numbered.drop("text"), "item").select("item_id", "rank", "doc_id", "score")
