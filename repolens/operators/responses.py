"""Model-call logs and streamed responses.

Event payloads are parsed once into Spark's VARIANT type
(``try_parse_json``), so heterogeneous chunk shapes -- content deltas, tool
call deltas, usage records, malformed lines -- are read with typed
``try_variant_get`` paths and never fail the job.  Usage records go through
``MAP<STRING,STRING>`` plus per-key ``try_cast`` so one nested or fractional
value cannot null the whole record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import py_strip

# Fixed values that must equal the reference's behaviour.
DATA_PREFIX = "data: "
END_MARKER = "[DONE]"
MAX_TOOL_ROUNDS = 10
UNKNOWN_TOOL_ERROR = "Error: Tool {name} not found."

TOOL_DELTA = "array<struct<index:int,id:string,function:struct<name:string,arguments:string>>>"


def parse_event_lines(lines: DataFrame, key: str = "response_id", order: str = "line_no",
                      line_col: str = "line", stop_at_done: bool = False, trim: bool = True) -> DataFrame:
    """Every line with ``payload`` (text after ``data: ``), ``is_done`` and
    ``chunk`` (VARIANT, null for non-data, end-marker or malformed lines).

    ``trim`` strips lines first (the tool-loop reader does, the plain reader
    does not); ``stop_at_done`` drops everything from the first end marker on
    (plain reader) instead of skipping the marker (tool-loop reader).
    """
    ln = py_strip(line_col) if trim else F.col(line_col)
    is_data = ln.startswith(DATA_PREFIX)
    payload = F.when(is_data, F.substring(ln, len(DATA_PREFIX) + 1, 1 << 30))
    df = lines.select(key, order, payload.alias("payload"))
    df = df.withColumn("is_done", F.coalesce(F.col("payload") == END_MARKER, F.lit(False)))
    if stop_at_done:
        # First end marker per key as an aggregate joined back (a window per
        # key would put a hot key's lines in one task).
        first = df.where("is_done").groupBy(key).agg(F.min(order).alias("_first_done"))
        df = df.join(first, key, "left")
        df = df.where(F.col("_first_done").isNull() | (F.col(order) < F.col("_first_done"))).drop("_first_done")
    chunk = F.when(~F.col("is_done"), F.try_parse_json("payload"))
    return df.withColumn("chunk", chunk)


def event_line_source(lines: DataFrame, key: str = "response_id", order: str = "line_no",
                      line_col: str = "line", stop_at_done: bool = False, trim: bool = True) -> DataFrame:
    """The valid JSON chunks of an event-line table, in long form:
    ``key, order, chunk`` (VARIANT)."""
    p = parse_event_lines(lines, key, order, line_col, stop_at_done, trim)
    return p.where(F.col("chunk").isNotNull()).select(key, order, "chunk")


def chunk_fields(chunks: DataFrame) -> DataFrame:
    """Typed fields of each chunk: content delta, tool-call deltas, usage."""
    v = F.col("chunk")
    return chunks.select(
        "*",
        F.try_variant_get(v, "$.choices[0].delta.content", "string").alias("content"),
        F.try_variant_get(v, "$.choices[0].delta.tool_calls", TOOL_DELTA).alias("tool_deltas"),
        F.try_variant_get(v, "$.usage", "map<string,string>").alias("usage"))


def _nz(x: Column) -> Column:
    return F.when(x != 0, x)


def usage_tokens(usage: Column) -> tuple[Column, Column]:
    """(input, output) tokens of one usage record, with the reference's key
    rules: when neither ``prompt_tokens`` nor ``input_tokens`` is a key the
    input is ``total_tokens - completion_tokens`` (missing = 0, may be
    negative); otherwise the first non-zero of the two, else 0.  Output is the
    first non-zero of ``completion_tokens`` and ``output_tokens``, else 0.
    An empty or null record counts 0/0."""
    def get(k):
        return usage[k].try_cast("bigint")

    has_pi = F.map_contains_key(usage, "prompt_tokens") | F.map_contains_key(usage, "input_tokens")
    fallback = F.coalesce(get("total_tokens"), F.lit(0)) - F.coalesce(get("completion_tokens"), F.lit(0))
    inp = F.when(usage.isNull() | (F.size(usage) == 0), F.lit(0)).when(
        ~has_pi, fallback).otherwise(F.coalesce(_nz(get("prompt_tokens")), _nz(get("input_tokens")), F.lit(0)))
    out = F.coalesce(_nz(get("completion_tokens")), _nz(get("output_tokens")), F.lit(0))
    out = F.when(usage.isNull() | (F.size(usage) == 0), F.lit(0)).otherwise(out)
    return inp.cast("bigint"), out.cast("bigint")


def usage_totals(calls: DataFrame, run_col: str = "run", seconds_col: str = "seconds",
                 usage_col: str = "usage_json") -> DataFrame:
    """A2: per run, number of calls, seconds, input, output and total tokens
    and output tokens per second (0 when no time).  A run without calls has
    no row.  Partial/final aggregation (map-side combine) keeps a hot run
    cheap."""
    m = F.from_json(F.col(usage_col), "map<string,string>")
    inp, out = usage_tokens(m)
    per = calls.select(F.col(run_col).alias("run"), F.col(seconds_col).cast("double").alias("s"),
                       inp.alias("i"), out.alias("o"))
    agg = per.groupBy("run").agg(F.count("*").alias("calls"), F.sum("s").alias("seconds"),
                                 F.sum("i").alias("input_tokens"), F.sum("o").alias("output_tokens"))
    return agg.select(
        "run", "calls", F.round("seconds", 6).alias("seconds"), "input_tokens", "output_tokens",
        (F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"),
        F.round(F.when(F.col("seconds") > 0, F.col("output_tokens") / F.col("seconds")).otherwise(F.lit(0.0)), 6)
        .alias("tokens_per_second"))


def response_usage(lines: DataFrame, key: str = "response_id", order: str = "line_no",
                   line_col: str = "line") -> DataFrame:
    """A3: per response, the last non-zero prompt and completion counts over
    its usage chunks (0 if none) and their sum."""
    p = chunk_fields(parse_event_lines(lines, key, order, line_col))
    u = p.select(key, order, F.col("usage"))
    get = lambda k: F.col("usage")[k].try_cast("bigint")
    pt = F.coalesce(_nz(get("prompt_tokens")), _nz(get("input_tokens")), F.lit(0))
    ct = F.coalesce(_nz(get("completion_tokens")), _nz(get("output_tokens")), F.lit(0))
    u = u.select(key, order, F.when(F.size("usage") > 0, pt).alias("pt"), F.when(F.size("usage") > 0, ct).alias("ct"))
    agg = u.groupBy(key).agg(
        F.coalesce(F.expr(f"max_by(pt, {order}) FILTER (WHERE pt > 0)"), F.lit(0)).alias("prompt_tokens"),
        F.coalesce(F.expr(f"max_by(ct, {order}) FILTER (WHERE ct > 0)"), F.lit(0)).alias("completion_tokens"))
    return agg.withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))


def assemble_responses(lines: DataFrame, key: str = "response_id", order: str = "line_no",
                       line_col: str = "line") -> DataFrame:
    """A4: per response, the content fragments concatenated in order and the
    tool calls: per tool-call index the last non-empty id and the
    concatenated name and arguments, listed in order of first appearance.  A
    line number counts once: of lines delivered again under one number the
    smallest content and the smallest tool-call deltas count.  Output ``key, content, tool_calls ARRAY<STRUCT<index,id,name,arguments>>``.
    """
    p = chunk_fields(event_line_source(lines, key, order, line_col))
    # One pass over the parsed chunks: a two-level fold per (key, bucket)
    # then per key carries both the content fragments and the tool-call
    # deltas, so every line is parsed once.
    c = p.select(key, order, F.when(F.col("content") != "", F.col("content")).alias("content"), "tool_deltas")
    frag = F.when(F.col("content").isNotNull(), F.struct(F.col(order).alias("o"), F.col("content").alias("t")))
    tools = F.when(F.size("tool_deltas") > 0, F.struct(F.col(order).alias("o"), F.col("tool_deltas").alias("d")))
    lvl1 = (c.groupBy(key, F.floor(F.col(order) / 4096).alias("_b"))
            .agg(F.min(order).alias("_o"),
                 F.array_sort(F.collect_list(frag)).alias("_t"), F.count("content").alias("_n"),
                 F.array_sort(F.collect_list(tools)).alias("_d")))
    lvl1 = lvl1.select(key, "_o", F.array_join(F.transform(first_of_each("_t"), lambda x: x["t"]), "").alias("_t"), "_n", first_of_each("_d").alias("_d"))
    lvl2 = lvl1.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("_o", "_t", "_d"))).alias("_parts"), F.sum("_n").alias("_n"))
    content = F.when(F.col("_n") > 0, F.array_join(F.transform("_parts", lambda x: x["_t"]), ""))
    # All tool-call deltas of the response in stream order (chunk order, then
    # position inside the chunk).
    deltas = F.flatten(F.transform(F.flatten(F.transform("_parts", lambda x: x["_d"])), lambda x: x["d"]))
    out = lvl2.select(key, content.alias("content"), deltas.alias("_deltas"))
    return out.select(key, "content", F.when(F.size("_deltas") > 0, merged_calls("_deltas")).alias("tool_calls"))


def first_of_each(parts: str) -> Column:
    """Of a sorted ``ARRAY<STRUCT<o, ..>>`` column the first entry of each ``o``."""
    return F.filter(parts, lambda x, i: (i == 0) | (F.col(parts)[F.greatest(i - 1, F.lit(0))]["o"] != x["o"]))


def merged_calls(deltas: str) -> Column:
    """Tool calls of an ordered array of deltas: per index, in order of first
    appearance, the last non-empty id and the joined names and arguments."""
    numbered = F.transform(deltas, lambda d: d.withField("index", F.coalesce(d["index"], F.lit(0))))

    def call(i):
        ds = F.filter(numbered, lambda d: d["index"] == i)
        ids = F.filter(F.transform(ds, lambda d: d["id"]), lambda x: x.isNotNull() & (x != ""))
        return F.struct(i.alias("index"),
                        F.coalesce(F.try_element_at(ids, F.lit(-1)), ds[0]["id"]).alias("id"),
                        F.array_join(F.transform(ds, lambda d: d["function"]["name"]), "").alias("name"),
                        F.array_join(F.transform(ds, lambda d: d["function"]["arguments"]), "").alias("arguments"))

    return F.transform(F.array_distinct(F.transform(numbered, lambda d: d["index"])), call)


def iteration_limit_audit(rounds: DataFrame, run_col: str = "run", order_col: str = "ts",
                          is_tool_round: Column | None = None, cap: int = MAX_TOOL_ROUNDS) -> DataFrame:
    """Per run, the number of leading rounds that requested tools (the
    loop continues only while rounds call tools) and whether it reached the
    cap of ``cap`` rounds without a final answer.  A null run is a run."""
    flag = is_tool_round if is_tool_round is not None else F.col("has_tool_call")
    r = rounds.select(F.col(run_col).alias("run"), F.col(order_col).alias("o"), flag.alias("tool"))
    first_final = r.groupBy(F.col("run").alias("f_run")).agg(F.min(F.when(~F.col("tool"), F.col("o"))).alias("ff"))
    lead = (r.join(first_final, F.col("run").eqNullSafe(F.col("f_run")))
            .groupBy("run").agg(F.count_if(F.col("tool") & (F.col("ff").isNull() | (F.col("o") < F.col("ff"))))
                                .alias("leading_tool_rounds")))
    return lead.withColumn("hit_limit", F.col("leading_tool_rounds") >= cap)


def validate_calls(calls: DataFrame, registry: DataFrame, id_col: str = "event_id", tool_col: str = "tool",
                   args_col: str = "args") -> DataFrame:
    """Per call, ``ok``, ``unknown_tool``, ``bad_json`` (not a JSON
    object), ``unexpected_argument`` or ``missing_argument`` against a
    registry ``(tool, param, required)``.  The registry is folded to one row
    per tool (param and required lists) before the join."""
    reg = registry.groupBy("tool").agg(
        F.collect_set("param").alias("params"),
        F.collect_set(F.when(F.col("required"), F.col("param"))).alias("required"))
    c = calls.select(F.col(id_col).alias("call_id"), F.col(tool_col).alias("tool"),
                     F.from_json(F.col(args_col), "map<string,string>").alias("m"))
    j = c.join(reg, "tool", "left")
    keys = F.map_keys("m")
    unexpected = F.array_sort(F.array_except(keys, F.col("params")))
    missing = F.array_sort(F.array_except(F.col("required"), keys))
    status = (F.when(F.col("params").isNull(), "unknown_tool")
              .when(F.col("m").isNull(), "bad_json")
              .when(F.size(unexpected) > 0, "unexpected_argument")
              .when(F.size(missing) > 0, "missing_argument")
              .otherwise("ok"))
    detail = (F.when(F.col("params").isNull(), F.concat(F.lit("Error: Tool "), F.col("tool"), F.lit(" not found.")))
              .when(F.col("m").isNull(), F.lit(None).cast("string"))
              .when(F.size(unexpected) > 0, F.array_join(unexpected, ","))
              .when(F.size(missing) > 0, F.array_join(missing, ",")))
    return j.select("call_id", "tool", status.alias("status"), detail.alias("detail"))
