"""Registered queries over model-call logs and streamed responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import responses as R
from ..sources import views as V
from ..sources.tables import Tables
from .registry import register

_N = {"o_n": "SELECT response_id, max(seq) AS n FROM v_chunks GROUP BY response_id"}


@register("event_line_source", """
SELECT response_id, CAST(seq AS BIGINT) AS line_no, frag AS content, false AS has_tool_calls, false AS has_usage
FROM v_chunks
UNION ALL SELECT response_id, n + 1, NULL, true, false FROM o_n WHERE response_id % 3 = 0
UNION ALL SELECT response_id, n + 2, NULL, true, false FROM o_n WHERE response_id % 3 = 0
UNION ALL SELECT response_id, n + 3, NULL, true, false FROM o_n WHERE response_id % 6 = 0
UNION ALL SELECT response_id, n + 4, NULL, false, true FROM o_n
UNION ALL SELECT response_id, n + 5, NULL, false, true FROM o_n""", _N)
def q_event_line_source(spark, sf_dir):
    c = R.chunk_fields(R.event_line_source(V.v_event_lines(Tables(spark, sf_dir))))
    return c.select("response_id", "line_no", "content",
                    F.coalesce(F.size("tool_deltas") > 0, F.lit(False)).alias("has_tool_calls"),
                    F.coalesce(F.size("usage") > 0, F.lit(False)).alias("has_usage"))


def _tok(key: str) -> str:
    return f"TRY_CAST(json_extract_string(usage_json, '$.{key}') AS BIGINT)"


def _has(key: str) -> str:
    return f"list_contains(json_keys(usage_json), '{key}')"


@register("usage_totals", f"""
SELECT run, count(*) AS calls, round(sum(seconds), 6) AS seconds,
       CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens,
       CAST(sum(i) + sum(o) AS BIGINT) AS total_tokens,
       round(CASE WHEN sum(seconds) > 0 THEN sum(o) / sum(seconds) ELSE 0 END, 6) AS tokens_per_second
FROM (
  SELECT run, seconds,
    CASE WHEN usage_json IS NULL OR usage_json = '{{}}' THEN 0
         WHEN NOT ({_has('prompt_tokens')} OR {_has('input_tokens')})
           THEN coalesce({_tok('total_tokens')}, 0) - coalesce({_tok('completion_tokens')}, 0)
         ELSE coalesce(nullif({_tok('prompt_tokens')}, 0), nullif({_tok('input_tokens')}, 0), 0) END AS i,
    CASE WHEN usage_json IS NULL THEN 0
         ELSE coalesce(nullif({_tok('completion_tokens')}, 0), nullif({_tok('output_tokens')}, 0), 0) END AS o
  FROM v_calls) x
GROUP BY run""")
def q_usage_totals(spark, sf_dir):
    return R.usage_totals(V.v_calls(Tables(spark, sf_dir)))


@register("response_usage", """
SELECT response_id,
       CAST(CASE WHEN response_id % 7 = 0 THEN 5 ELSE (response_id % 7) * 10 END AS BIGINT) AS prompt_tokens,
       CAST(n AS BIGINT) AS completion_tokens,
       CAST(CASE WHEN response_id % 7 = 0 THEN 5 ELSE (response_id % 7) * 10 END + n AS BIGINT) AS total_tokens
FROM o_n""", _N)
def q_response_usage(spark, sf_dir):
    return R.response_usage(V.v_event_lines(Tables(spark, sf_dir)))


@register("assemble_responses", """
SELECT conv_id * 100 + turn AS response_id, text AS content,
       CASE WHEN (conv_id * 100 + turn) % 6 = 0 THEN 2 WHEN (conv_id * 100 + turn) % 3 = 0 THEN 1 ELSE 0 END
         AS n_tool_calls,
       CASE WHEN (conv_id * 100 + turn) % 3 = 0 THEN
         '0:call_' || CAST(conv_id * 100 + turn AS VARCHAR) || ':read_file:{"filepath": "p'
         || CAST(conv_id * 100 + turn AS VARCHAR) || '.py"}'
         || CASE WHEN (conv_id * 100 + turn) % 6 = 0
                 THEN ';1:call_' || CAST(conv_id * 100 + turn AS VARCHAR) || '_b:list_files:{}' ELSE '' END
       END AS tool_calls
FROM conversations WHERE role = 'assistant' AND length(text) > 0""")
def q_assemble_responses(spark, sf_dir):
    a = R.assemble_responses(V.v_event_lines(Tables(spark, sf_dir)))
    txt = F.array_join(F.transform("tool_calls", lambda x: F.concat_ws(
        ":", x["index"].cast("string"), x["id"], x["name"], x["arguments"])), ";")
    n = F.when(F.col("tool_calls").isNull(), F.lit(0)).otherwise(F.size("tool_calls"))
    return a.select("response_id", "content", n.alias("n_tool_calls"), txt.alias("tool_calls"))


@register("iteration_limit_audit", """
SELECT run, count(*) FILTER (WHERE is_tool AND (ff IS NULL OR ts < ff)) AS leading_tool_rounds,
       count(*) FILTER (WHERE is_tool AND (ff IS NULL OR ts < ff)) >= 10 AS hit_limit
FROM (SELECT run, ts, event_type = 'click' AS is_tool,
             min(CASE WHEN event_type <> 'click' THEN ts END) OVER (PARTITION BY run) AS ff FROM v_calls) x
GROUP BY run""")
def q_iteration_limit_audit(spark, sf_dir):
    calls = V.v_calls(Tables(spark, sf_dir))
    return R.iteration_limit_audit(calls, "run", "ts", F.col("event_type") == "click")


@register("validate_calls", """
SELECT e.event_id AS call_id, e.event_type AS tool,
  CASE WHEN r.tool IS NULL THEN 'unknown_tool'
       WHEN NOT json_valid(e.props) OR json_type(e.props) <> 'OBJECT' THEN 'bad_json'
       WHEN len(list_filter(json_keys(e.props), lambda k: NOT list_contains(r.params, k))) > 0 THEN 'unexpected_argument'
       WHEN coalesce(len(list_filter(r.req, lambda k: NOT list_contains(json_keys(e.props), k))), 0) > 0
         THEN 'missing_argument'
       ELSE 'ok' END AS status,
  CASE WHEN r.tool IS NULL THEN 'Error: Tool ' || e.event_type || ' not found.'
       WHEN NOT json_valid(e.props) OR json_type(e.props) <> 'OBJECT' THEN NULL
       WHEN len(list_filter(json_keys(e.props), lambda k: NOT list_contains(r.params, k))) > 0
         THEN array_to_string(list_sort(list_distinct(list_filter(json_keys(e.props),
                                lambda k: NOT list_contains(r.params, k)))), ',')
       WHEN coalesce(len(list_filter(r.req, lambda k: NOT list_contains(json_keys(e.props), k))), 0) > 0
         THEN array_to_string(list_sort(list_distinct(list_filter(r.req,
                                lambda k: NOT list_contains(json_keys(e.props), k)))), ',')
       END AS detail
FROM events e LEFT JOIN (
  SELECT tool, list(param) AS params, list(param) FILTER (WHERE required) AS req FROM v_registry GROUP BY tool) r
  ON r.tool = e.event_type""")
def q_validate_calls(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return R.validate_calls(t.events, V.v_registry(t), "event_id", "event_type", "props")
