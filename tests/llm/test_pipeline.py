"""The corpus pipeline: what each stage keeps, against its operator's rule."""

from pyspark.sql import functions as F

import corpus_pipeline as P
from repolens.llm.pii import base_spans
from tests.conftest import SF_SMALL



def test_stages_on_the_small_table(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["language", "jaccard_join", "pii", "mix", "bpe"]
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF_SMALL)
        assert out.schema.names == docs.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        if name == "jaccard_join":
            from tests.llm.test_pair_operators import _brute_components
            comp = _brute_components([(r["doc_id"], r["text"]) for r in docs.collect()])
            assert sorted(r["doc_id"] for r in out.collect()) == sorted({c for _, _, c in comp})
        if name == "pii":
            rows = out.collect()
            assert not any(base_spans(r["text"] or "") for r in rows) and all(r["n_chars"] == len(r["text"]) for r in rows)
            clean = {r["doc_id"]: r["text"] for r in docs.collect() if not base_spans(r["text"] or "")}
            after = {r["doc_id"]: r["text"] for r in rows}
            assert sum(after[i] != t for i, t in clean.items()) <= 0.01 * len(clean)
        if name == "language":
            assert out.count() >= 0.99 * docs.count()
    assert P.run(spark, SF_SMALL).count() > 0


def test_odd_rows_and_extra_columns(spark):
    text = spark.read.parquet(f"{SF_SMALL}/documents.parquet").where("lang = 'en'").select("text").limit(40).collect()
    rows = [(i, r[0], "en", "a" if i % 2 else None, len(r[0]), "k", "s", "n") for i, r in enumerate(text)]
    rows += [(100, None, "en", "a", None, "k", "s", "n"), (101, "", None, "a", 0, "k", "s", "n"), (None, text[0][0], "en", "b", 5, "k", "s", "n"), rows[0], rows[1],
             (102, "word " * 40_000, "en", "b", 7, "k", "s", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, keep string, spans string, language string")
    for name, stage in P.STAGES:
        for some in (docs, docs.limit(0)):
            out = stage(spark, some, SF_SMALL)
            if name != "bpe":
                assert out.columns == docs.columns
                assert not out.count() or out.where("keep <> 'k' or spans <> 's' or language <> 'n'").count() == 0
            elif some is docs:
                assert out.count() == len(rows)
    once = P.one_of_each_group(spark, docs, SF_SMALL)
    assert once.where("doc_id is null").count() == 1 and once.where("doc_id = 0").count() == 1
    assert once.groupBy("doc_id").count().where("count > 1").count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert P.identify_language(spark, unlabelled, SF_SMALL).count() == len(rows)


def test_a_task_needs_one_python_worker_at_a_time(spark, monkeypatch):
    """Two Python steps of one stage run in two workers for every task, and
    all stay for the next stages: an executor's memory has no room for them."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    steps = lambda df: df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython")
    written, write = [], P.language.write_table
    monkeypatch.setattr(P.language, "write_table", lambda df, *a, **k: written.append(steps(df)) or write(df, *a, **k))
    assert steps(P.identify_language(spark, docs, SF_SMALL)) == 1 and max(written) == 1
    assert steps(P.remove_personal_data(spark, docs, SF_SMALL)) == 1
    assert steps(P.encode(spark, docs, SF_SMALL)) == 1
