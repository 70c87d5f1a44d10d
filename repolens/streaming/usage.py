"""Usage totals kept up to date as call records arrive.

The batch operator ``usage_totals`` is reused unchanged on a streaming
DataFrame: Spark keeps the per-run partial aggregates in its state store.
A new run id starts a new total (the reference's ``reset()``).

The totals table is a log of upserts.  A micro-batch writes the runs that it
changed, and no others, into the folder of its epoch (update mode); the
latest row of a run counts.  An epoch that was written whole is not written
again, so replaying one after a failure changes nothing.  ``compact_usage``
folds the epochs written so far into one base table.  Nothing goes to driver
memory.

    out/epoch=<n>/        the runs changed by epoch n
    out/base=<n>/         the latest totals of all epochs up to n
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.responses import usage_totals


def usage_stream(spark: SparkSession, source_dir: str, schema: StructType, max_files_per_trigger: int | None = None,
                 fmt: str = "parquet", record_id: str | None = None, event_time: str | None = None,
                 late_by: str | None = None) -> DataFrame:
    """Streaming call records -> streaming per-run totals.

    With ``record_id`` a record counts once, however often it is delivered
    (records without an id count each time).  The ids seen are state;
    ``event_time`` and ``late_by`` bound it: an id is forgotten when it is older than the
    watermark, and records that come later than that are dropped, so choose
    a bound that the source keeps; every record needs a time then."""
    r = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    calls = r.load(source_dir)
    if record_id is not None:
        # A record without an id gets one of its own: nothing equals it.
        own = F.when(F.col(record_id).isNull(), F.uuid())
        calls = calls.withColumns({"_id": F.col(record_id), "_own": own})
        if event_time is not None and late_by is not None:
            calls = calls.withWatermark(event_time, late_by).dropDuplicatesWithinWatermark(["_id", "_own"])
        else:
            calls = calls.dropDuplicates(["_id", "_own"])
    return usage_totals(calls)


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _written(spark: SparkSession, out_dir: str) -> dict[str, list[int]]:
    """Numbers of the epochs and bases that were written whole."""
    root, fs = _hadoop(spark, out_dir)
    found: dict[str, list[int]] = {"epoch": [], "base": []}
    if fs.exists(root):
        for x in fs.listStatus(root):
            kind, _, n = x.getPath().getName().partition("=")
            if kind in found and n.isdigit() and fs.exists(_hadoop(spark, f"{out_dir}/{kind}={n}/_SUCCESS")[0]):
                found[kind].append(int(n))
    return {k: sorted(v) for k, v in found.items()}


def upsert_epoch(batch: DataFrame, epoch_id: int, out_dir: str) -> None:
    """Writes the changed runs of one epoch, unless that has been done."""
    spark = batch.sparkSession
    done = _written(spark, out_dir)
    if epoch_id not in done["epoch"] and epoch_id > max(done["base"], default=-1):
        batch.write.mode("overwrite").parquet(f"{out_dir}/epoch={epoch_id}")


def _latest(spark: SparkSession, out_dir: str, done: dict[str, list[int]]) -> DataFrame | None:
    base = max(done["base"], default=-1)
    parts = [(base, f"base={base}")] if base >= 0 else []
    parts += [(n, f"epoch={n}") for n in done["epoch"] if n > base]
    if not parts:
        return None
    rows = [spark.read.parquet(f"{out_dir}/{name}").withColumn("_epoch", F.lit(n).cast("bigint")) for n, name in parts]
    cols = [c for c in rows[0].columns if c not in ("run", "_epoch")]
    last = reduce(DataFrame.unionByName, rows).groupBy("run").agg(F.max_by(F.struct(*cols), "_epoch").alias("t"))
    return last.select("run", "t.*")


def read_usage(spark: SparkSession, out_dir: str) -> DataFrame | None:
    """The latest totals of every run (a null run is a run); None before the
    first epoch."""
    return _latest(spark, out_dir, _written(spark, out_dir))


def compact_usage(spark: SparkSession, out_dir: str) -> int | None:
    """Folds all epochs written so far into one base table and deletes what it
    replaces; returns the last epoch folded.  A run of it that fails leaves the older
    tables in place.  Call it while nobody reads the table."""
    done = _written(spark, out_dir)
    rows = _latest(spark, out_dir, done)
    base = max(done["base"], default=-1)
    upto = max(done["epoch"], default=-1)
    if rows is None or upto <= base:
        return base if base >= 0 else None
    rows.write.mode("overwrite").parquet(f"{out_dir}/base={upto}")
    for kind, n in [("epoch", n) for n in done["epoch"]] + [("base", n) for n in done["base"]]:
        p, fs = _hadoop(spark, f"{out_dir}/{kind}={n}")
        fs.delete(p, True)
    return upto


def start_usage_stream(spark: SparkSession, source_dir: str, schema: StructType, out_dir: str, checkpoint_dir: str,
                       available_now: bool = True, processing_time: str | None = None,
                       max_files_per_trigger: int | None = None, record_id: str | None = None, event_time: str | None = None,
                       late_by: str | None = None) -> StreamingQuery:
    """Runs ``usage_stream`` into the upsert log ``out_dir`` (see ``read_usage``)."""
    totals = usage_stream(spark, source_dir, schema, max_files_per_trigger, record_id=record_id, event_time=event_time, late_by=late_by)
    out_dir = out_dir.rstrip("/")
    w = (totals.writeStream.outputMode("update").foreachBatch(lambda batch, epoch: upsert_epoch(batch, epoch, out_dir))
         .option("checkpointLocation", checkpoint_dir))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time or "10 seconds")
    return w.start()
