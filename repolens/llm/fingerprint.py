"""Document fingerprints (operator 7): threshold-scaled sketches.

A fingerprint keeps every hash of a document's five-word shingles below a
fixed fraction of the hash range, and at least its ``FLOOR`` smallest, so
that short documents are kept whole.  Both rules look at hash values only, so
the fingerprint of a union is made from fingerprints (``merge``), and two
fingerprints are comparable up to the smaller of their limits, however
unequal their documents are.

Defined results: a null text is an empty one; its fingerprint is an empty
string, as is that of white space.  A text of fewer than five words has one
shingle.  Documents are ordered by doc_id (null first), then by a hash of the text; rows
equal in both are one document in that order and each gets the same result.
The next of the last document is the first; a single document is its own
next.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

SHINGLE, FRACTION, FLOOR = 5, 32, 32
_BELOW = np.uint64((1 << 64) // FRACTION)
_TOP = np.uint64((1 << 64) - 1)


def _retained(h: np.ndarray) -> np.ndarray:
    """Of sorted distinct hashes, those that the sketch keeps."""
    return h[:max(int(np.searchsorted(h, _BELOW)), min(FLOOR, len(h)))]


def sketch(text: str | None) -> np.ndarray:
    """Sorted retained shingle hashes of a whole text."""
    return _retained(np.unique(W.shingles(W.split(text), SHINGLE)))


def to_string(s: np.ndarray) -> str:
    """16 hex digits a hash, ascending."""
    return s.astype(">u8").tobytes().hex()


def from_string(s: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(s), ">u8").astype(np.uint64)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two shingle sets."""
    return _retained(np.union1d(a, b))


def _limit(s: np.ndarray) -> np.uint64:
    """Up to which hash value the sketch is complete."""
    if len(s) < FLOOR:
        return _TOP
    return max(s[-1], _BELOW - np.uint64(1))


def compare(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """Estimated containment (of the smaller in the larger) and Jaccard
    similarity.  Equal sketches give 1; nothing to compare gives 0."""
    if np.array_equal(a, b):
        return 1.0, 1.0
    top = min(_limit(a), _limit(b))
    a, b = a[:np.searchsorted(a, top, "right")], b[:np.searchsorted(b, top, "right")]
    least = min(len(a), len(b))
    if not least:
        return 0.0, 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / least, both / (len(a) + len(b) - both)


def edit(text: str, following: str) -> str:
    """The last half of ``text`` replaced by as much of ``following``."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
_SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double")


def _pairs(batches):
    """Sorted rows (part, ahead, doc_id, text) -> for every row of a part that
    isn't there only to look ahead, its result with the next document."""
    waiting: list = []  # rows of one document
    for batch in batches:
        out: list[tuple] = []
        for part, ahead, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
            if waiting and waiting[0][0] == part and (ahead or (doc_id, text) != waiting[0][1:3]):
                own, other = waiting[0], sketch(text)
                changed = edit(own[2], text)
                edited = sketch(changed)
                row = (own[1], len(own[2]), hashlib.sha256(changed.encode()).hexdigest(), to_string(own[3]),
                       to_string(edited), compare(own[3], edited)[0], compare(own[3], other)[0])
                out += [row] * len(waiting)
                waiting = []
            else:
                other = None
            if not ahead:
                if waiting:
                    waiting.append(waiting[0])
                else:
                    waiting = [(part, doc_id, text, sketch(text) if other is None else other)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(_TYPES)], names=_NAMES)


def with_following(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, ahead, doc_id, text): documents dealt to ranges of their order
    and sorted; the first of each range stands, marked, at the end of the
    range before as well.  One shuffle of the texts; the driver sees one key
    per range."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    n = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    firsts = (rows.select("doc_id", "h").repartitionByRange(n, "doc_id", "h").groupBy(F.spark_partition_id().alias("p"))
              .agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "h")).alias("first")))
    bounds = sorted(tuple(r["first"]) for r in firsts.collect())

    @F.arrow_udf("array<struct<part:int,ahead:boolean>>")
    def places(ids: pa.Array, hashes: pa.Array) -> pa.Array:
        out = []
        for i, h in zip(ids.to_pylist(), hashes.to_pylist()):
            key = (i is not None, i or 0, h)
            at = bisect_right(bounds, key) - 1
            out.append([{"part": at, "ahead": False}] + ([{"part": (at - 1) % len(bounds), "ahead": True}] if bounds[at] == key else []))
        return pa.array(out, pa.list_(pa.struct([("part", pa.int32()), ("ahead", pa.bool_())])))

    return (rows.withColumn("place", F.explode(places(F.col("doc_id"), F.col("h"))))
            .select("place.part", "place.ahead", "doc_id", "text", "h")
            .repartition("part").sortWithinPartitions("part", "ahead", "doc_id", "h", "text")
            .select("part", "ahead", "doc_id", "text"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its fingerprint, that of its edited text, and its
    containment estimates against the edited and the next text."""
    return with_following(docs, id_col, text_col).mapInArrow(_pairs, _SCHEMA)
