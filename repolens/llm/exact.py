"""Exact duplicate removal with a cuckoo-filter index (operator 12).

The index holds the live 64-bit digests of normalised texts.  It is dealt into
parts by the digests' high bits; a part is a cuckoo filter: buckets of four
slots with a 16-bit fingerprint, each digest in one of two buckets, and beside
the fingerprints the stored key and its number of live copies.  Insertion
moves fingerprints to their other bucket; when that does not end or a part is
nearly full, the part doubles its buckets and places its stored keys again.
Deletion lowers the live number and frees the slot at 0.  As a table the index
has one row per occupied slot, so it is kept, read and advanced like any other
Parquet table.

A digest that was inserted more than once is a hit.  The contents of hits are
compared themselves: rows of one digest are grouped by their whole normalised
text, each text once per map task.

Defined results: a null text counts as empty; of equal texts the row with the
most code points in the original text stays, then the one with the smallest
id (null ids last), then one of the rows that are alike in both.  Repeated rows count
one by one; an empty table gives an empty result.  Only the id and text
columns are read, so other columns can't clash.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, write_table
from .words import mix

#: Digests that a part should hold; slots of a bucket; moves before a part
#: grows; share of slots that may be taken.
PART_KEYS, SLOTS, MAX_MOVES, FULL = 1 << 20, 4, 200, 0.9
#: Digests summed up in a map task before they are sent.
BUFFER = 1 << 20
#: Characters that do not count (fixed by the definition of equal texts).
IGNORED = " \t\n\v\f\r"

INDEX_SCHEMA = "bits int, part int, buckets int, bucket int, slot int, fingerprint int, h long, live long"


def normalised(text: Column) -> Column:
    """The text without white space; null as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in IGNORED:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


class CuckooFilter:
    """Live digests (int64) of one part."""

    def __init__(self, buckets: int = 64):
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.buckets, self.taken = buckets, 0
        self.fingerprint = np.zeros(buckets * SLOTS, np.uint16)  # 0: free
        self.key, self.live = np.zeros(buckets * SLOTS, np.int64), np.zeros(buckets * SLOTS, np.int64)

    def _places(self, keys: np.ndarray):
        """Fingerprints and the two buckets of each key."""
        h = mix(keys.view(np.uint64))
        f = np.maximum(h >> np.uint64(48), np.uint64(1)).astype(np.uint16)
        a = (h & np.uint64(self.buckets - 1)).astype(np.int64)
        return f, a, self._other(a, f)

    def _other(self, bucket: np.ndarray, f: np.ndarray) -> np.ndarray:
        """The other bucket of a fingerprint, told from the fingerprint alone."""
        return bucket ^ (mix(f.astype(np.uint64)) & np.uint64(self.buckets - 1)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each live key, else -1: the fingerprint first, a hit is
        compared with the stored key."""
        f, a, b = self._places(keys)
        at = np.full(len(keys), -1)
        for bucket in (a, b):
            for s in range(SLOTS):
                place = bucket * SLOTS + s
                hit = np.flatnonzero(self.fingerprint[place] == f)
                hit = hit[self.key[place[hit]] == keys[hit]]
                at[hit] = place[hit]
        return at

    def insert(self, keys: np.ndarray, times: np.ndarray) -> None:
        """Adds copies of different keys."""
        at = self.find(keys)
        old = at >= 0
        self.live[at[old]] += times[old]
        keys, times = keys[~old], times[~old]
        buckets = self.buckets
        while self.taken + len(keys) > FULL * buckets * SLOTS:
            buckets *= 2
        if buckets > self.buckets:
            self._resize(buckets)
        self._place(keys, times)

    def _put(self, place, f, keys, times) -> None:
        self.fingerprint[place], self.key[place], self.live[place] = f, keys, times

    def _place(self, keys: np.ndarray, times: np.ndarray) -> None:
        f, a, b = self._places(keys)
        rest = np.arange(len(keys))
        for bucket in (a, b) * SLOTS:
            free = self.fingerprint.reshape(-1, SLOTS)[bucket[rest]] == 0
            able = np.flatnonzero(free.any(axis=1))
            place, first = np.unique(bucket[rest[able]] * SLOTS + free[able].argmax(axis=1), return_index=True)
            won = rest[able[first]]
            self._put(place, f[won], keys[won], times[won])
            self.taken += len(won)
            rest = rest[~np.isin(rest, won)]
        for i in rest.tolist():
            self._move_in(keys[i], times[i])

    def _move_in(self, key, time) -> None:
        """Places one key by moving others to their other buckets."""
        f, a, _ = self._places(np.array([key]))
        f, bucket = f[:1], a[:1]
        for turn in range(MAX_MOVES):
            row = self.fingerprint[bucket[0] * SLOTS:bucket[0] * SLOTS + SLOTS]
            free = np.flatnonzero(row == 0)
            place = bucket * SLOTS + (free[0] if len(free) else (turn * 7 + int(f[0])) % SLOTS)
            moved = self.fingerprint[place], self.key[place][0], self.live[place][0]
            self._put(place, f, key, time)
            if len(free):
                self.taken += 1
                return
            f, key, time = moved
            bucket = self._other(bucket, f)
        self._resize(2 * self.buckets, np.array([key]), np.array([time]))

    def _resize(self, buckets: int, key=None, time=None) -> None:
        """More buckets, filled again from the stored keys."""
        held = np.flatnonzero(self.fingerprint)
        keys, live = self.key[held], self.live[held]
        self._clear(buckets)
        self._place(keys if key is None else np.concatenate([keys, key]), live if key is None else np.concatenate([live, time]))

    def delete(self, keys: np.ndarray, times: np.ndarray) -> None:
        """Removes copies of different keys; unknown keys are left out."""
        at = self.find(keys)
        known = at >= 0
        self.live[at[known]] -= times[known]
        gone = at[known][self.live[at[known]] <= 0]
        self.fingerprint[gone] = 0
        self.taken -= len(gone)

    def load(self, buckets: int, bucket: np.ndarray, slot: np.ndarray, f: np.ndarray, keys: np.ndarray, live: np.ndarray) -> None:
        """Some slots of a stored part."""
        if self.buckets != buckets:
            self._clear(buckets)
        self._put(bucket.astype(np.int64) * SLOTS + slot, f.astype(np.uint16), keys, live)
        self.taken += len(keys)

    def rows(self, bits: int, part: int):
        """Record batches of INDEX_SCHEMA."""
        held = np.flatnonzero(self.fingerprint)
        for at in (held[k:k + (1 << 16)] for k in range(0, len(held), 1 << 16)):
            same = lambda x: np.full(len(at), x, np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (same(bits), same(part), same(self.buckets), (at // SLOTS).astype(np.int32), (at % SLOTS).astype(np.int32),
                                       self.fingerprint[at].astype(np.int32), self.key[at], self.live[at])],
                names=["bits", "part", "buckets", "bucket", "slot", "fingerprint", "h", "live"])


def _sums(keys: np.ndarray, times: np.ndarray):
    keys, back = np.unique(keys, return_inverse=True)
    out = np.zeros(len(keys), np.int64)
    np.add.at(out, back, times)
    return keys, out


def _partial(batches):
    """(h, n): the copies of each digest in a stretch of a task's rows."""
    held, size = [], 0

    def sums():
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int64))], names=["h", "n"])

    for batch in batches:
        held.append(batch.column(0).to_numpy(zero_copy_only=False))
        size += len(held[-1])
        if size >= BUFFER:
            yield sums()
            held, size = [], 0
    if size:
        yield sums()


def _advance(batches):
    """Rows sorted by (part, kind): stored slots (0), copies to insert (1) and
    to delete (2); gives the parts as they are then."""
    part, bits, one = None, 0, CuckooFilter()
    for batch in batches:
        all_bits, parts, kind, buckets, bucket, slot, f, h, n = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        cuts = np.flatnonzero((np.diff(parts) != 0) | (np.diff(kind) != 0)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(parts)]):
            if lo == hi:
                continue
            if parts[lo] != part:
                if part is not None:
                    yield from one.rows(bits, part)
                bits, part, one = int(all_bits[lo]), int(parts[lo]), CuckooFilter()
            if kind[lo] == 0:
                one.load(int(buckets[lo]), bucket[lo:hi], slot[lo:hi], f[lo:hi], h[lo:hi].copy(), n[lo:hi])
            else:
                (one.insert if kind[lo] == 1 else one.delete)(*_sums(h[lo:hi].copy(), n[lo:hi]))
    if part is not None:
        yield from one.rows(bits, part)


def advance(index: DataFrame | None, inserted: DataFrame | None = None, deleted: DataFrame | None = None) -> DataFrame:
    """The index (INDEX_SCHEMA) after inserting and then deleting the digests
    of the one-column frames (h); None is the empty index.  When its parts are
    too few for the live digests, all are dealt anew from the stored keys."""
    changes = [(write_table(d.mapInArrow(_partial, "h long, n long"), "exact-digests"), kind) for d, kind in ((inserted, 1), (deleted, 2)) if d is not None]
    held, old_bits = index.agg(F.count(F.lit(1)), F.max("bits")).first() if index is not None else (0, None)
    bits = max(old_bits or 0, ((held + sum(d.count() for d, kind in changes if kind == 1)) // PART_KEYS).bit_length())
    part = (F.shiftrightunsigned(F.col("h"), 64 - bits).cast("int") if bits else F.lit(0)).alias("part")
    fresh = lambda kind, n: [F.lit(bits).alias("bits"), part, F.lit(kind).alias("kind"), *[F.lit(0).alias(c) for c in ("buckets", "bucket", "slot", "fingerprint")],
                             "h", F.col(n).alias("n")]
    rows = [d.select(*fresh(kind, "n")) for d, kind in changes]
    if held and bits == old_bits:
        rows.append(index.select("bits", "part", F.lit(0).alias("kind"), "buckets", "bucket", "slot", "fingerprint", "h", F.col("live").alias("n")))
    elif held:
        rows.append(index.select(*fresh(1, "live")))
    dealt = reduce(DataFrame.unionByName, rows).repartition(max(1 << bits, 8), "part").sortWithinPartitions("part", "kind")
    return dealt.mapInArrow(_advance, INDEX_SCHEMA)


def find_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id, keep_id (id of the row of its group that stays),
    group_size, kept, text_sha256 (of the normalised text)."""
    text = normalised(F.col(text_col))
    thin = write_table(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"),
                                   F.coalesce(F.length(text_col), F.lit(0)).alias("chars"), F.xxhash64(text).alias("h"), F.sha2(text, 256).alias("sha")), "exact-thin")
    index = write_table(advance(None, thin.select("h")), "exact-index")
    hits = broadcast_if_small(index.where("live > 1").select(F.col("h").alias("hit")))
    # The contents of hits: each digest's different texts, compared as they are.
    contents = (docs.select(F.xxhash64(text).alias("h"), text.alias("content")).join(hits, F.col("h") == F.col("hit"), "left_semi")
                .groupBy("h", "content").agg(F.count(F.lit(1)).alias("n"))
                .select("h", F.sha2("content", 256).alias("sha"), "n").where("n > 1"))
    order = F.struct((-F.col("chars")).alias("c"), F.col("doc_id").isNull().alias("x"), F.col("doc_id").alias("d"), F.col("row").alias("r"))
    best = (thin.join(hits, F.col("h") == F.col("hit"), "left_semi").groupBy("h", "sha").agg(F.min(order).alias("best")))
    groups = write_table(contents.join(best, ["h", "sha"]).select(F.col("h").alias("g_h"), F.col("sha").alias("g_sha"), "n", "best"), "exact-groups")
    rows = thin.join(broadcast_if_small(groups), (F.col("h") == F.col("g_h")) & (F.col("sha") == F.col("g_sha")), "left")
    return rows.select("doc_id", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("best.d")).alias("keep_id"),
                       F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
                       (F.col("n").isNull() | (F.col("row") == F.col("best.r"))).alias("kept"), F.col("sha").alias("text_sha256"))
