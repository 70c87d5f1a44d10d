"""Registered queries: Structured Streaming twins of the usage and assembly
operators, fed from files written under the shared checkpoint folder and run
with ``availableNow`` (several micro-batches) to completion."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.summarize import distributed_row_number
from ..session import scratch_folder
from ..sources import views as V
from ..sources.tables import Tables
from ..streaming.assembly import assembly_stream, rocksdb_state
from ..streaming.usage import read_usage, start_usage_stream
from .registry import ORACLE, register

#: Micro-batches that a stream is read in; files per batch follow the data.
BATCHES = 3


def _files_per_batch(spark, path: str) -> int:
    return max(1, -(-len(spark.read.parquet(path).inputFiles()) // BATCHES))


def _scratch(spark, name: str) -> str:
    return scratch_folder(spark, f"streams/{name}")


@register("stream_usage")
def q_stream_usage(spark, sf_dir):
    root = _scratch(spark, "usage")
    calls = V.v_calls(Tables(spark, sf_dir))
    # A third of the records is delivered twice.
    calls.write.parquet(f"{root}/in")
    calls.where(F.col("event_id") % 3 == 0).write.mode("append").parquet(f"{root}/in")
    q = start_usage_stream(spark, f"{root}/in", calls.schema, f"{root}/out", f"{root}/ckpt",
                           max_files_per_trigger=_files_per_batch(spark, f"{root}/in"), record_id="event_id")
    q.awaitTermination()
    return read_usage(spark, f"{root}/out")


@register("stream_assembly")
def q_stream_assembly(spark, sf_dir):
    root = _scratch(spark, "assembly")
    # The view leaves gaps in its line numbers; a log has none.
    lines = distributed_row_number(V.v_event_lines(Tables(spark, sf_dir)), ["response_id"], "line_no", "n")
    lines = lines.withColumn("line_no", F.col("n") - 1).drop("n")
    done = F.col("line") == "data: [DONE]"
    # Three waves, out of order across micro-batches: end markers, then odd,
    # then even lines.
    for wave in (done, ~done & (F.col("line_no") % 2 == 1), ~done & (F.col("line_no") % 2 == 0)):
        lines.where(wave).write.mode("append").parquet(f"{root}/in")
    src = (spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", _files_per_batch(spark, f"{root}/in"))
           .parquet(f"{root}/in"))
    with rocksdb_state(spark):
        q = (assembly_stream(src, timeout_ms=None).writeStream.format("parquet").outputMode("append")
             .option("checkpointLocation", f"{root}/ckpt").trigger(availableNow=True).start(f"{root}/out"))
    q.awaitTermination()
    out = spark.read.parquet(f"{root}/out")
    tc = F.from_json("tool_calls_json", "array<struct<index:int,id:string,name:string,arguments:string>>")
    txt = F.array_join(F.transform(tc, lambda x: F.concat_ws(
        ":", x["index"].cast("string"), x["id"], x["name"], x["arguments"])), ";")
    n = F.when(tc.isNull(), F.lit(0)).otherwise(F.size(tc))
    return out.select("response_id", "content", n.alias("n_tool_calls"), txt.alias("tool_calls"))


# The streaming twins must equal their batch operators.
ORACLE["stream_usage"] = ORACLE["usage_totals"]
ORACLE["stream_assembly"] = ORACLE["assemble_responses"]
