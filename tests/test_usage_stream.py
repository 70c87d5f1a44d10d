"""R1 as a log of upserts: replayed epochs, repeated records, write volume, compaction."""

import pytest
from pyspark.sql import functions as F

from repolens.operators.responses import usage_totals
from repolens.session import scratch_folder
from repolens.streaming import usage

SCHEMA = "event_id bigint, run string, ts timestamp, seconds double, usage_json string"


def _calls(spark, rows):
    df = spark.createDataFrame([(i, run, s, '{"prompt_tokens":%d,"completion_tokens":2}' % t) for i, run, s, t in rows],
                               "event_id bigint, run string, seconds double, usage_json string")
    return df.withColumn("ts", F.timestamp_seconds(F.lit(1_600_000_000) + F.coalesce("event_id", F.lit(0)))).select("event_id", "run", "ts", "seconds", "usage_json")


def _run(spark, root, **more):
    q = usage.start_usage_stream(spark, f"{root}/in", _calls(spark, [(1, "a", 1.0, 1)]).schema, f"{root}/out", f"{root}/ckpt",
                                 max_files_per_trigger=1, record_id="event_id", **more)
    q.awaitTermination()
    assert q.exception() is None


def _rows(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)


@pytest.mark.parametrize("bound", [{}, {"event_time": "ts", "late_by": "1 hour"}])
def test_upserts_equal_batch_totals_and_follow_changed_runs(spark, bound):
    root = scratch_folder(spark, "streams/upsert")
    waves = [[(1, "a", 1.0, 5), (2, "b", 2.0, 6), (None, None, 1.0, 7), (None, None, 1.0, 7)], [(3, "a", 1.0, 8), (1, "a", 1.0, 5)], [(4, "c", 1.0, 1), (4, "c", 1.0, 1)]]
    changed, seen = [{"a", "b", None}, {"a"}, {"c"}], 0
    assert usage.read_usage(spark, f"{root}/out") is None
    for n, wave in enumerate(waves):
        _calls(spark, wave).coalesce(1).write.mode("append").parquet(f"{root}/in")
        _run(spark, root, **bound)
        epochs = usage._written(spark, f"{root}/out")["epoch"]
        new = [r["run"] for e in epochs[seen:] for r in spark.read.parquet(f"{root}/out/epoch={e}").collect()]
        assert set(new) == changed[n] and len(new) == len(changed[n])
        seen = len(epochs)
    once = _calls(spark, [(1, "a", 1.0, 5), (2, "b", 2.0, 6), (None, None, 1.0, 7), (None, None, 1.0, 7), (3, "a", 1.0, 8), (4, "c", 1.0, 1)])
    want = _rows(usage_totals(once))
    assert _rows(usage.read_usage(spark, f"{root}/out")) == want

    # An epoch that comes again changes nothing, before and after compaction.
    wrong = usage.read_usage(spark, f"{root}/out").withColumn("calls", F.lit(99).cast("bigint")).checkpoint()
    usage.upsert_epoch(wrong, 0, f"{root}/out")
    assert _rows(usage.read_usage(spark, f"{root}/out")) == want
    last = usage.compact_usage(spark, f"{root}/out")
    assert usage._written(spark, f"{root}/out") == {"epoch": [], "base": [last]}
    usage.upsert_epoch(wrong, last, f"{root}/out")
    assert _rows(usage.read_usage(spark, f"{root}/out")) == want and usage.compact_usage(spark, f"{root}/out") == last

    # The stream goes on after a compaction; an epoch cut short is written anew.
    _calls(spark, [(5, "c", 1.0, 3)]).coalesce(1).write.mode("append").parquet(f"{root}/in")
    wrong.write.parquet(f"{root}/out/epoch={last + 1}")
    p, fs = usage._hadoop(spark, f"{root}/out/epoch={last + 1}/_SUCCESS")
    fs.delete(p, False)
    _run(spark, root, **bound)
    assert _rows(usage.read_usage(spark, f"{root}/out")) == _rows(usage_totals(once.unionAll(_calls(spark, [(5, "c", 1.0, 3)]))))
