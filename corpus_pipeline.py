"""Corpus pipeline: five stages, each one operator of ``repolens.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``docs``.  ``run`` writes each stage's result to
the shared checkpoint folder and reads it back as the next one's input.

Defined results: rows with null ids, null or empty texts, null languages or
sources and repeated rows pass through the stages as their operators say; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from repolens.llm import bpe, jaccard, language, mixture, pii
from repolens.llm.common import broadcast_if_small, prepare, write_table
from repolens.llm.queries import tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told.  Without any labelled
    row there is no model and every document stays."""
    prepare(spark)
    model = language.fit(docs)
    if model is None:
        return docs
    # The row travels as one struct, so no column of it can clash.
    rows = docs.select(F.struct("*").alias("row"), "text", "lang", "source")
    return language.identify(rows, model, F.col("lang"), F.col("source")).where("keep").select("row.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of similar ones;
    of rows with one id the one with the smallest text.  Rows with a null id
    stay."""
    prepare(spark)
    found = write_table(jaccard.similar_components(docs), "pipeline-components")
    others = found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("__id")).distinct()
    kept = docs.join(broadcast_if_small(others), F.col("doc_id") == F.col("__id"), "left_anti")
    twice = (found.where(F.col("doc_id") == F.col("component_id")).groupBy(F.col("doc_id").alias("__id")).count()
             .where(F.col("count") > 1).select("__id"))
    if not twice.limit(1).count():
        return kept
    twice = broadcast_if_small(twice)
    first = Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last())
    again = (kept.join(twice, F.col("doc_id") == F.col("__id")).withColumn("__at", F.row_number().over(first)).where(F.col("__at") == 1))
    return kept.join(twice, F.col("doc_id") == F.col("__id"), "left_anti").unionByName(again.select(*docs.columns))


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sanitises every text; n_chars follows."""
    prepare(spark)
    clean = pii.sanitise(docs.select(F.struct("*").alias("row"), "text"))
    new = {"text": F.col("text"), "n_chars": F.coalesce(F.length("text").cast("long"), F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return clean.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix of its source takes it."""
    prepare(spark)
    return mixture.mix_rows(docs, mixture.cyclic_weights)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests per row of the mixed corpus."""
    prepare(spark)
    rows = docs.select("doc_id", "text")
    return bpe.token_digests(bpe.encode_table(rows, bpe.Tokenizer(spark, tokenizer_path())))


STAGES = [("language", identify_language), ("jaccard_join", one_of_each_group), ("pii", remove_personal_data),
          ("mix", mix_sources), ("bpe", encode)]
#: The language model, the sanitised texts and the token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
