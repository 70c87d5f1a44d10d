"""Mixing sources to target weights (operator 4, DataFrame functions only).

Every document has a fixed 60-bit hash.  Per source, token sums by hash
bucket show in which bucket the budget is used up; only rows of that boundary
bucket are summed again by their next hash bits, until the boundary is a
single hash value.  Selection is then a comparison of each row's hash with
its source's threshold: no sort, no row order, the same on every run.

Defined results: a null text has size 0; a null source is a source of its
own.  Rows equal in id and text share their hash and so their decision.  A
source without words has target 0.  An empty table gives an empty result.  A
source's sum misses its target by at most half of what shares the boundary
hash value, one document as a rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, broadcast_if_small, number_rows, write_table

#: Hash bits in all, and bits that each refinement resolves.
HASH_BITS, STEP_BITS = 60, 10


def document_size(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def document_hash(doc_id: Column, text: Column) -> Column:
    """60 bits of an MD5 over id and text, as a long."""
    both = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(both), 1, HASH_BITS // 4), 16, 10).cast("long")


def cyclic_weights(sources: DataFrame, weights: tuple[float, ...] = (5, 2, 1)) -> DataFrame:
    """``weights`` dealt to the rows of ``sources`` by code point order of
    ``source``, null last, beginning anew after the last weight."""
    d = number_rows(sources, [F.col("source").isNull(), F.col("source")], "__at")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("__at") % len(weights)).cast("int") + 1)
    return d.withColumn("weight", w).drop("__at")


def source_targets(sources: DataFrame, share: float, max_repeat: int) -> DataFrame:
    """(source, source_size, weight) -> the same with ``target``.  The budget
    is ``share`` times all sizes, dealt by weight; what exceeds ``max_repeat``
    times a source's size goes to the others by weight until none exceeds it.
    Each round reads three sums."""
    cap = F.col("source_size") * F.lit(float(max_repeat))
    total, weight = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    if not total or not weight:
        return sources.withColumn("target", F.lit(0.0))
    budget, rate, capped = share * total, share * total / weight, -1
    while True:
        full = F.col("weight") * F.lit(rate) >= cap
        n, used, free = sources.agg(F.count(F.when(full, 1)), F.coalesce(F.sum(F.when(full, F.col("source_size"))), F.lit(0)),
                                    F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        if n == capped or not free:
            break
        capped, rate = n, (budget - max_repeat * used) / free
    full = F.col("weight") * F.lit(rate) >= cap
    return sources.withColumn("target", F.when(full | F.lit(not free), cap).otherwise(F.col("weight") * F.lit(rate)))


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def _thresholds(thin: DataFrame, targets: DataFrame) -> DataFrame:
    """Adds base (whole passes over the source) and cut: rows whose hash is
    below cut are taken once more."""
    size = F.col("source_size").cast("double")
    state = (targets.withColumn("base", F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("int"))
             .withColumn("need", F.when(size > 0, F.col("target") - F.col("base") * size).otherwise(0.0))
             .withColumn("before", F.lit(0).cast("long")).withColumn("at", F.lit(0).cast("long"))
             .withColumn("inside", F.col("source_size")).withColumn("lo", F.lit(0).cast("long"))
             .withColumn("hi", F.lit(1).cast("long")))
    bits = 0
    while bits < HASH_BITS:
        bits += STEP_BITS
        s = broadcast_if_small(state.select(F.col("source").alias("s_source"), "need", "before", "at", "lo", "hi"))
        inside = F.shiftright("hash", HASH_BITS - bits + STEP_BITS) == F.col("at")
        hist = (thin.join(s, _same(F.col("source"), F.col("s_source")))
                .where(inside & (F.col("lo") < F.col("hi")) & (F.col("need") > 0))
                .groupBy("source", "need", "before", F.shiftright("hash", HASH_BITS - bits).alias("bucket"))
                .agg(F.sum("size").alias("words"), F.min("hash").alias("lo"), F.max("hash").alias("hi")))
        # At most 2 ** STEP_BITS buckets a source.
        after = F.sum("words").over(Window.partitionBy("source").orderBy("bucket")) + F.col("before")
        edge = (hist.withColumn("after", after).where(F.col("after") > F.col("need"))
                .groupBy("source").agg(F.min(F.struct("bucket", "after", "words", "lo", "hi")).alias("e")))
        edge = edge.select(F.col("source").alias("e_source"), "e")
        joined = state.join(broadcast_if_small(edge), _same(F.col("source"), F.col("e_source")), "left")
        state = write_table(joined.select(
            *targets.columns, "base", "need",
            F.coalesce(F.col("e.after") - F.col("e.words"), F.col("before")).alias("before"),
            F.coalesce(F.col("e.bucket"), F.when(F.col("lo") < F.col("hi"), F.lit(0)).otherwise(F.col("at"))).cast("long").alias("at"),
            F.coalesce(F.col("e.words"), F.col("inside")).alias("inside"),
            F.coalesce(F.col("e.lo"), F.when(F.col("lo") < F.col("hi"), F.lit(0)).otherwise(F.col("lo"))).cast("long").alias("lo"),
            F.coalesce(F.col("e.hi"), F.when(F.col("lo") < F.col("hi"), F.lit(0)).otherwise(F.col("hi"))).cast("long").alias("hi")),
            "mix-state")
        if not state.where(F.col("lo") < F.col("hi")).limit(1).count():
            break
    nearer = F.col("before") + F.col("inside") - F.col("need") < F.col("need") - F.col("before")
    cut = F.when(F.col("need") <= 0, F.lit(0)).otherwise(F.col("lo") + F.when(nearer, 1).otherwise(0)).cast("long")
    return state.select(*targets.columns, "base", cut.alias("cut"))


def plan_mixture(docs: DataFrame, weigh, share: float = 1.5, max_repeat: int = 2, id_col: str = "doc_id",
                 text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """Returns (documents, sources).  documents: doc_id, source, size, hash,
    the narrow table that everything is summed over.  sources: source,
    source_size, weight, target, base, cut.  ``weigh`` turns (source,
    source_size) into the same with a weight column."""
    thin = write_table(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                                   document_size(F.col(text_col)).alias("size"),
                                   document_hash(F.col(id_col), F.col(text_col)).alias("hash")), "mix-docs")
    sizes = thin.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = write_table(source_targets(write_table(weigh(sizes), "mix-weights"), share, max_repeat), "mix-targets")
    return thin, _thresholds(thin, targets)


def take(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows with source, size and hash -> the same with source_size, target,
    copies and taken."""
    s = broadcast_if_small(sources.select(F.col("source").alias("s_source"), "source_size", "target", "base", "cut"))
    copies = F.col("base") + F.when(F.col("hash") < F.col("cut"), 1).otherwise(0)
    return (docs.join(s, _same(F.col("source"), F.col("s_source")))
            .withColumn("copies", copies).withColumn("taken", (F.col("size") * copies).cast("long"))
            .drop("s_source", "base", "cut"))


def mix_rows(docs: DataFrame, weigh, share: float = 1.5, max_repeat: int = 2) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as the mix takes it,
    with the columns of ``docs``, whatever their names."""
    _, sources = plan_mixture(docs, weigh, share, max_repeat)
    # The row travels as one struct, so no column of it can clash.
    rows = docs.select(F.struct("*").alias("row"), F.col("source").alias("of"), document_hash(F.col("doc_id"), F.col("text")).alias("hash"))
    s = broadcast_if_small(sources.select("source", "base", "cut"))
    copies = F.col("base") + F.when(F.col("hash") < F.col("cut"), 1).otherwise(0)
    return (rows.join(s, _same(F.col("of"), F.col("source")))
            .select("row", F.explode(F.array_repeat(F.lit(0), copies.cast("int")))).select("row.*"))
