"""Language identification by Bayesian evidence fusion (operator 5).

Text evidence is a naive Bayes model over hashed byte trigrams of lower-cased
letters.  It is combined with up to three further kinds of evidence: a
declared language (markup or metadata), the address suffix, and the host.
How far each is to be trusted is counted over the whole corpus by grouped
aggregation of the text model's own decisions: P(declared | language),
P(suffix | language), and P(language | host) smoothed towards the host's
parent domain, which is smoothed towards the corpus.

Defined results: a null or letterless text gives no text evidence; the other
kinds then decide, and such a row is rejected (``keep`` false) like one whose
text is less likely under its best language than under evenly drawn trigrams,
or whose best posterior is below ``MIN_POSTERIOR``.  A null declared
language, suffix or host is evidence of nothing.  Equal posteriors go to the
language first in order.  Repeated rows give repeated results; an empty table
gives an empty one; without any label there is no model and ``fit`` returns
None; more than ``MAX_LANGUAGES`` labels are a ValueError.
Whole texts are scored.  Other columns pass through; the result columns
replace columns of the same name.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, write_table
from .words import give_back, hold

#: Training texts a language (expected number, drawn by hash; the bound on
#: what is read for training), trigram bins, smoothing counts.
MAX_TRAINING, BINS, SMOOTH = 2_000, 1 << 15, 0.5
#: Trigrams a text counts for at most (trigrams are far from independent).
MAX_EVIDENCE = 60
#: Smoothing weight of the level above a host; rejection limits.
HOST_WEIGHT, MIN_POSTERIOR, MIN_TRIGRAMS = 20.0, 0.5, 30
#: Languages that a model tells apart at most: the labels with most texts.
MAX_LANGUAGES = 500

_CLASS = np.array([c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256)], np.uint32)
_CHUNK = 1 << 20


def _trigrams(text: str | None):
    """Bins of the trigrams of a text, in chunks; those without a
    letter are left out."""
    data = _CLASS[np.frombuffer((" " + (text or "").lower() + " ").encode(), np.uint8)]
    for at in range(0, len(data) - 2, _CHUNK):
        b = data[at:at + _CHUNK + 2]
        x, y, z = b[:-2], b[1:-1], b[2:]
        keep = (x != 32) | (y != 32) | (z != 32)
        yield (((x << 16 | y << 8 | z)[keep] * np.uint32(2654435761)) >> np.uint32(17)) & np.uint32(BINS - 1)


def _training_counts(batches):
    """Rows (label, bin, n), summed over the task."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for label, text in zip(*(c.to_pylist() for c in batch.columns)):
            for bins in _trigrams(text):
                sums.setdefault(label, np.zeros(BINS, np.int64))
                sums[label] += np.bincount(bins, minlength=BINS)
        give_back()
    for label, n in sums.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([label] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())],
                                         names=["label", "bin", "n"])


class LanguageModel:
    """Languages in order and log-likelihoods by bin and language."""

    def __init__(self, languages: list[str], table: np.ndarray):
        self.languages, self.table = languages, table

    def score(self, text: str | None) -> list[float]:
        """Log-likelihood by language, then the number of trigrams."""
        total, n = np.zeros(len(self.languages)), 0
        for bins in _trigrams(text):
            total += self.table[bins].sum(axis=0, dtype=np.float64)
            n += len(bins)
        return [*total.tolist(), float(n)]


def score_column(spark, model: LanguageModel, text: Column) -> Column:
    """array<double>: the log-likelihoods of ``LanguageModel.score``.  Marked as
    not deterministic, else Spark moves it into filters on the scores, too, and
    every task scores its texts twice, in two Python workers at a time."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("array<double>")
    def scores(a: pa.Array) -> pa.Array:
        hold("language")
        out = pa.array([shared.value.score(s.as_py()) for s in a], pa.list_(pa.float64()))
        give_back()
        return out

    return scores.asNondeterministic()(text)


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "lang", max_training: int = MAX_TRAINING,
        max_languages: int = MAX_LANGUAGES) -> LanguageModel | None:
    """Fit on about ``max_training`` texts of each label, drawn by hash, for the
    ``max_languages`` labels with most texts (equal numbers by code point);
    texts of rarer labels are judged by these, and such a label is no evidence.
    What the driver gets is bounded by bins times languages."""
    spark = labelled.sparkSession
    rows = labelled.select(F.col(label_col).alias("label"), F.col(text_col).alias("text")).dropna()
    sizes = {r[0]: r[1] for r in rows.groupBy("label").count().orderBy(F.desc("count"), "label").limit(max_languages).collect()}
    if not sizes:
        return None
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, max_training / n))])
    drawn = F.pmod(F.xxhash64(F.lit(5), F.col("text")), F.lit(1 << 20)) < share[F.col("label")] * (1 << 20)
    sample = write_table(rows.where(drawn), "language-sample")
    counted = sample.mapInArrow(_training_counts, "label string, bin int, n long").groupBy("label", "bin").agg(F.sum("n").alias("n")).collect()
    languages = sorted({r["label"] for r in counted}) or sorted(sizes)
    counts = np.full((BINS, len(languages)), SMOOTH)
    for label, at, n in counted:
        counts[at, languages.index(label)] += n
    return LanguageModel(languages, np.log(counts / counts.sum(axis=0)).astype(np.float32))


def declared_language(value: Column) -> Column:
    """Primary subtag in lower case, null if there is none."""
    tag = F.regexp_extract(F.lower(F.trim(value)), "^([a-z]{2,3})(?:[-_].*)?$", 1)
    return F.when(tag != "", tag)


def address_suffix(host: Column) -> Column:
    """Last label of a host that has more than one."""
    return F.when(host.contains("."), F.element_at(F.split(host, r"\."), -1))


def parent_domain(host: Column) -> Column:
    """Last two labels of a host (the host itself if it has no more)."""
    return F.substring_index(host, ".", -2)


def _normal(values: Column) -> Column:
    """Array divided by its sum."""
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return F.transform(values, lambda x: x / total)


def _counts(n: int) -> list[Column]:
    return [F.sum(F.when(F.col("top") == i, F.col("n")).otherwise(0)).cast("double") for i in range(n)]


def _evidence(counts: DataFrame, n: int):
    """From corpus counts (declared, suffix, host, top, n): likelihood tables
    of declared language and suffix, and the host prior table."""
    base = counts.agg(F.array(*_counts(n)).alias("c")).first()["c"]
    base = [x or 0.0 for x in base]
    world = [(x + 1.0) / (sum(base) + n) for x in base]

    def given_language(col: str) -> DataFrame:
        kinds = counts.where(F.col(col).isNotNull()).groupBy(col).agg(F.array(*_counts(n)).alias("c"))
        total = kinds.agg(F.count(F.lit(1)), F.array(*[F.sum(F.col("c")[i]) for i in range(n)])).first()
        sums = [x or 0.0 for x in total[1]]
        return kinds.select(F.col(col).alias(f"__{col}"), F.array(*[
            F.log((F.col("c")[i] + 1.0) / (sums[i] + total[0])) for i in range(n)]).alias(f"__{col}_log"))

    def smoothed(level: Column) -> Column:
        size = F.aggregate("c", F.lit(0.0), lambda a, x: a + x)
        return F.zip_with("c", level, lambda x, p: (x + HOST_WEIGHT * p) / (size + HOST_WEIGHT))

    known = counts.where(F.col("host").isNotNull())
    parents = (known.groupBy(parent_domain(F.col("host")).alias("parent")).agg(F.array(*_counts(n)).alias("c"))
               .select("parent", smoothed(F.array(*[F.lit(x) for x in world])).alias("p")))
    hosts = known.groupBy("host").agg(F.array(*_counts(n)).alias("c")).withColumn("parent", parent_domain(F.col("host")))
    hosts = hosts.join(parents, "parent").select(F.col("host").alias("__host"),
                                                 F.transform(smoothed(F.col("p")), lambda x: F.log(x)).alias("__host_log"))
    return given_language("declared"), given_language("suffix"), hosts, [math.log(x) for x in world]


def identify(df: DataFrame, model: LanguageModel, declared: Column, host: Column, suffix: Column | None = None,
             text_col: str = "text", scored: Column | None = None) -> DataFrame:
    """``df`` with language, confidence, text_language and keep.  ``host`` and
    ``declared`` may be null; ``scored`` is a column that already holds the
    text scores."""
    n, spark = len(model.languages), df.sparkSession
    names = F.array(*[F.lit(x) for x in model.languages])
    score = scored if scored is not None else score_column(spark, model, F.col(text_col))
    tag = declared_language(declared)
    said = F.when(tag.isin(model.languages), tag).when(tag.isNotNull(), "other")
    d = (df.withColumn("__s", score).withColumn("__said", said).withColumn("__at_host", F.lower(host))
         .withColumn("__ends", suffix if suffix is not None else F.lit(None).cast("string")))
    weight = F.least(F.lit(1.0), F.lit(float(MAX_EVIDENCE)) / F.greatest(F.element_at("__s", -1), F.lit(1.0)))
    text = F.transform(F.slice("__s", 1, n), lambda x: x * weight)
    best = lambda a: F.array_position(a, F.array_max(a)).cast("int") - 1
    counts = write_table(
        d.select(F.col("__said").alias("declared"), F.col("__ends").alias("suffix"), F.col("__at_host").alias("host"), "__s")
        .where(F.element_at("__s", -1) > 0).withColumn("top", best(F.slice("__s", 1, n)))
        .groupBy("declared", "suffix", "host", "top").agg(F.count(F.lit(1)).alias("n")), "language-counts")
    by_declared, by_suffix, by_host, world = _evidence(counts, n)
    zero, flat = F.array(*[F.lit(0.0)] * n), F.array(*[F.lit(x) for x in world])
    j = (d.join(broadcast_if_small(by_declared), F.col("__said") == F.col("__declared"), "left")
         .join(broadcast_if_small(by_suffix), F.col("__ends") == F.col("__suffix"), "left")
         .join(broadcast_if_small(by_host), F.col("__at_host") == F.col("__host"), "left"))
    plus = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    joint = plus(plus(text, F.coalesce("__declared_log", zero)), plus(F.coalesce("__suffix_log", zero), F.coalesce("__host_log", flat)))
    j = j.withColumn("__joint", joint).withColumn("__top", F.array_max("__joint"))
    j = j.withColumn("__p", _normal(F.transform("__joint", lambda x: F.exp(x - F.col("__top")))))
    j = j.withColumn("__at", best(F.col("__joint")))
    grams = F.element_at("__s", -1)
    strange = (grams >= MIN_TRIGRAMS) & (F.get("__s", F.col("__at")) < -math.log(BINS) * grams)
    out = (j.withColumn("language", F.get(names, F.col("__at"))).withColumn("confidence", F.array_max("__p"))
           .withColumn("text_language", F.when(grams > 0, F.get(names, best(F.slice("__s", 1, n)))))
           .withColumn("keep", (grams > 0) & ~strange & (F.array_max("__p") >= MIN_POSTERIOR)))
    keep = [c for c in df.columns if c not in ("language", "confidence", "text_language", "keep")]
    return out.select(*keep, "language", "confidence", "text_language", "keep")
