"""Phrase collocation mining by direct-address tiling (operator 11).

Words are counted per language and numbered by frequency.  Texts become
sequences of these numbers, with a break where a piece ends or a word is too
rare to be in a phrase.  Neighbours of a sequence are counted in square tiles
of the number plane: a tile with many pairs in a dense array (bincount of the
address in the tile), the others as sorted coordinates.  Frequent pairs are
numbered by frequency again and take the place of words: the neighbours of a
sequence of pairs are triples, those of a sequence of triples have four words.
Counts are added up by Spark between the levels, so each level's numbers and
counts are those of all texts.

Numbers reach the tasks as sorted arrays up to a bound of counted rows;
beyond it the sequences are joined to the numbers in a shuffle.

Defined results: a null text is empty, a null language is ``und``, repeated
rows count one by one, an empty table gives an empty result.  Only the
language and text columns are read, so other columns can't clash.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import number_rows, write_table

#: Side of a tile; pairs for each cell of a tile from which it is counted densely.
TILE_BITS, DENSE = 10, 1 / 16
#: Pairs counted together, words counted together in a task.
PAIRS, WORDS = 1 << 22, 1 << 19
#: Most words and most phrases whose numbers are sent to every task.
MAX_WORDS, MAX_PHRASES = 500_000, 4_000_000
#: Fixed values of the definition: least frequency, longest phrase, share (in
#: per cent) of a phrase's occurrences in a longer one that drops it, rows a language.
LEAST, LONGEST, INSIDE, TOP = 30, 4, 80, 2000

_CLASS = bytes(c + 32 if 65 <= c <= 90 else 10 if chr(c) in ".,;:!?\n\v\f\r" else 32 if c == 9 else c for c in range(256))
_BREAK = b"\n"


def words(text: str | None) -> list[bytes]:
    """Words of a text, with a break behind every piece."""
    out: list[bytes] = []
    for piece in (text or "").encode().translate(_CLASS).split(_BREAK):
        found = piece.split(b" ")
        out += [w for w in found if w] if b"" in found else found
        out.append(_BREAK)
    return out


def _count_words(batches):
    """(lang, word, n) over stretches of the task's rows."""
    held: dict[str, Counter] = {}

    def rows():
        for lang, n in held.items():
            n.pop(_BREAK, None)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array([w.decode() for w in n], pa.string()),
                                              pa.array(list(n.values()), pa.int64())], names=["lang", "word", "n"])
        held.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            held.setdefault(lang, Counter()).update(words(text.as_py()))
        if sum(map(len, held.values())) >= WORDS:
            yield from rows()
    yield from rows()


def _lists(arrays: list[np.ndarray], name: str = "ids") -> pa.RecordBatch:
    flat = np.concatenate([*arrays, np.empty(0, np.int32)]).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(np.cumsum([0, *map(len, arrays)]).astype(np.int32), pa.array(flat))], names=[name])


def _useful(ids: np.ndarray) -> np.ndarray:
    """A sequence without numbers that have no neighbour; one break between
    those that are left."""
    whole = ids >= 0
    beside = np.zeros(len(ids), bool)
    beside[:-1] |= whole[1:]
    beside[1:] |= whole[:-1]
    keep = whole & beside
    ids = np.where(keep, ids, -1)
    again = np.ones(len(ids), bool)
    again[1:] = keep[1:] | keep[:-1]
    return ids[again]


def _number_words(shared):
    """(lang, text) to sequences of word numbers."""
    def run(batches):
        ids: dict[str, dict[bytes, int]] = {}
        for lang, w, i in zip(*shared.value):
            ids.setdefault(lang, {})[w] = i
        for batch in batches:
            out = []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if lang in ids:
                    found = words(text.as_py())
                    out.append(_useful(np.fromiter(map(ids[lang].get, found, repeat(-1)), np.int32, len(found))))
            yield _lists([x for x in out if len(x) > 1])
    return run


def _pairs(ids: np.ndarray):
    """Places of neighbours in a flat array."""
    return np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))


def _number_pairs(shared):
    """Sequences to those of the numbers of their neighbours."""
    def run(batches):
        codes, numbers = shared.value
        for batch in batches:
            out = []
            for one in batch.column(0):
                ids = one.values.to_numpy(zero_copy_only=False).astype(np.int64)
                at = _pairs(ids)
                code = ids[at] << 32 | ids[at + 1]
                k = np.minimum(np.searchsorted(codes, code), max(len(codes) - 1, 0))
                new = np.full(len(ids), -1, np.int32)
                if len(codes):
                    new[at] = np.where(codes[k] == code, numbers[k], -1)
                out.append(_useful(new))
            yield _lists([x for x in out if len(x) > 1])
    return run


def tile_counts(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, n) of the different pairs of two arrays of numbers."""
    side = 1 << TILE_BITS
    tile = (left >> TILE_BITS) << 32 | right >> TILE_BITS
    order = np.argsort(tile, kind="stable")
    tile, code = tile[order], (left << 32 | right)[order]
    start = np.concatenate([[0], np.flatnonzero(np.diff(tile)) + 1]) if len(tile) else np.empty(0, np.int64)
    size = np.diff(np.append(start, len(tile)))
    dense = np.flatnonzero(size >= DENSE * side * side)
    rest, out = np.ones(len(tile), bool), []
    for lo, n in zip(start[dense].tolist(), size[dense].tolist()):
        rest[lo:lo + n] = False
        one = code[lo:lo + n]
        cells = np.bincount((one >> 32 & side - 1) << TILE_BITS | one & side - 1, minlength=side * side)
        at = np.flatnonzero(cells)
        corner = int(tile[lo])
        out.append((((corner >> 32) << TILE_BITS | at >> TILE_BITS) << 32 | (corner & (1 << 32) - 1) << TILE_BITS | at & side - 1, cells[at]))
    sparse = np.sort(code[rest])
    first = np.concatenate([[0], np.flatnonzero(np.diff(sparse)) + 1]) if len(sparse) else np.empty(0, np.int64)
    out.append((sparse[first], np.diff(np.append(first, len(sparse)))))
    code, n = (np.concatenate(x) for x in zip(*out))
    return code >> 32, code & (1 << 32) - 1, n.astype(np.int64)


def _count_pairs(batches):
    """(left, right, n) over stretches of the task's neighbours."""
    held, size = [], 0

    def rows():
        left, right, n = tile_counts(*(np.concatenate(x) for x in zip(*held)))
        return pa.RecordBatch.from_arrays([pa.array(left.astype(np.int32)), pa.array(right.astype(np.int32)), pa.array(n)], names=["left", "right", "n"])

    for batch in batches:
        # A sequence ends where the next one begins.
        lists = batch.column(0)
        ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
        at = np.setdiff1d(_pairs(ids), ends[:-1] - 1, assume_unique=True)
        held.append((ids[at], ids[at + 1]))
        size += len(at)
        if size >= PAIRS:
            yield rows()
            held, size = [], 0
    if size:
        yield rows()


def _regrouped(batches):
    """(length, [(place, number)]) to sequences."""
    for batch in batches:
        out = []
        for length, at in zip(*(c.to_pylist() for c in batch.columns)):
            ids = np.full(length, -1, np.int32)
            for x in at:
                ids[x["place"]] = x["id"]
            out.append(_useful(ids))
        yield _lists([x for x in out if len(x) > 1])


def _in_order(found: DataFrame) -> DataFrame:
    """Rows (row, length, place, id) to sequences."""
    each = found.groupBy("row", "length").agg(F.collect_list(F.struct("place", "id")).alias("at"))
    return each.select("length", "at").mapInArrow(_regrouped, "ids array<int>")


def number_texts(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(lang, text) to sequences of the numbers in ``known`` (lang, word, id)."""
    n = known.count()
    if n <= MAX_WORDS:
        t = known.select("lang", "word", "id").toArrow()
        shared = docs.sparkSession.sparkContext.broadcast((t["lang"].to_pylist(), [w.encode() for w in t["word"].to_pylist()], t["id"].to_pylist()))
        return docs.mapInArrow(_number_words(shared), "ids array<int>")

    @F.arrow_udf("array<string>")
    def split(texts: pa.Array) -> pa.Array:
        return pa.array([[None if w == _BREAK else w.decode() for w in words(t.as_py())] for t in texts], pa.list_(pa.string()))

    # Written, since a row's number must be the same in all its words.
    every = write_table(docs.select(F.monotonically_increasing_id().alias("row"), "lang", split(F.col("text")).alias("words")), "phrases-rows")
    each = every.select("row", "lang", F.size("words").alias("length"), F.posexplode("words").alias("place", "word")).where(F.col("word").isNotNull())
    return _in_order(each.join(known.select("lang", "word", "id"), ["lang", "word"]))


def number_neighbours(sequences: DataFrame, known: DataFrame) -> DataFrame:
    """Sequences of the numbers in ``known`` (left, right, id) of neighbours."""
    if known.count() <= MAX_PHRASES:
        t = known.select((F.col("left").cast("long") * (1 << 32) + F.col("right")).alias("code"), "id").toArrow()
        code, ids = t["code"].to_numpy(), t["id"].to_numpy().astype(np.int32)
        order = np.argsort(code)
        return sequences.mapInArrow(_number_pairs(sequences.sparkSession.sparkContext.broadcast((code[order], ids[order]))), "ids array<int>")
    pairs = F.arrays_zip(F.slice("ids", 1, F.size("ids") - 1).alias("left"), F.slice("ids", 2, F.size("ids") - 1).alias("right"))
    rows = write_table(sequences.select(F.monotonically_increasing_id().alias("row"), "ids"), "phrases-rows")
    each = (rows.select("row", F.size("ids").alias("length"), F.posexplode(pairs).alias("place", "pair"))
            .select("row", "length", "place", "pair.*"))
    return _in_order(each.join(known.select("left", "right", "id"), ["left", "right"]))


def _best_cut(words_: int):
    """The lowest-scoring cut of a phrase: struct (score, k, l, r)."""
    cut = lambda k: F.struct(F.expr(f"(cast(n as decimal(20,0)) * 2000000) div (cast(heads[{k - 1}] as decimal(20,0)) + tails[{words_ - k - 1}])").cast("long").alias("score"),
                             F.lit(k).alias("k"), F.expr(f"heads[{k - 1}]").alias("l"), F.expr(f"tails[{words_ - k - 1}]").alias("r"))
    return F.array_min(F.array(*[cut(k) for k in range(1, words_)]))


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP) -> DataFrame:
    """Per language its ``top`` phrases: lang, rank, phrase, a, l, r, n, score."""
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    counts = write_table(rows.mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "phrases-words")
    total = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    level = number_rows(counts.where(F.col("n") >= least), [F.col("n").desc(), F.col("lang"), F.col("word")], "id")
    # heads and tails: frequencies of the first and the last 1, 2, ... words.
    level = write_table(level.select(F.col("id").cast("int").alias("id"), "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "n",
                                     F.array("n").alias("heads"), F.array("n").alias("tails")), "phrases-1")
    sequences = write_table(number_texts(rows, level.withColumnRenamed("phrase", "word")), "phrases-numbers")
    levels = []
    for length in range(2, LONGEST + 1):
        pairs = sequences.mapInArrow(_count_pairs, "left int, right int, n long").groupBy("left", "right").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        pairs = number_rows(write_table(pairs, "phrases-pairs"), [F.col("n").desc(), F.col("left"), F.col("right")], "id")
        a = level.select(F.col("id").alias("left"), "lang", "phrase", "heads")
        b = level.select(F.col("id").alias("right"), F.col("last"), "tails")
        level = write_table(pairs.join(a, "left").join(b, "right").select(
            F.col("id").cast("int").alias("id"), "left", "right", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "n",
            F.concat("heads", F.array("n")).alias("heads"), F.concat("tails", F.array("n")).alias("tails")), f"phrases-{length}")
        levels.append(level)
        if length < LONGEST:
            sequences = write_table(number_neighbours(sequences, level), "phrases-numbers")
    # A phrase goes that mostly stands in a longer one; one word more is enough
    # to look at, since what is in between stands there as often.
    kept = []
    for k, level in enumerate(levels):
        if k + 1 < len(levels):
            longer = levels[k + 1]
            most = longer.select(F.explode(F.array("left", "right")).alias("id"), F.col("n").alias("longer")).groupBy("id").agg(F.max("longer").alias("longer"))
            level = level.join(most, "id", "left").where(F.col("longer").isNull() | (F.col("longer").cast("decimal(20,0)") * 100 < F.col("n").cast("decimal(20,0)") * INSIDE))
        kept.append(level.select("lang", "phrase", F.col("n").alias("a"), _best_cut(k + 2).alias("cut")))
    found = reduce(DataFrame.unionByName, kept).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase")))
    first = found.withColumn("rank", rank).where(F.col("rank") <= top)
    return first.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
