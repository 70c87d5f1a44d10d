"""Registered queries: change-set batching, per-batch calls and folding."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import PY_WHITESPACE
from ..operators import summarize as SM
from ..operators.calls import call_batches
from ..session import scratch_folder
from ..sources import views as V
from ..sources.tables import Tables
from .registry import register

# Deterministic stand-ins for the model calls used by the registered queries.
SUMMARY_WORDS = 15
FAIL_MODULUS = 7


def demo_summarizer(prompt: str) -> str:
    """First 15 words; fails (raises) when the prompt length is a multiple
    of 7, to exercise the error path."""
    if len(prompt) % FAIL_MODULUS == 0:
        raise ValueError("simulated model failure")
    return SM.first_words(prompt, SUMMARY_WORDS)


def demo_coordinator(prompt: str) -> str:
    """Last 15 words of the coordinator prompt, wrapped in a code fence."""
    return "```text\n" + " ".join(prompt.split()[-SUMMARY_WORDS:]) + "\n```"


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_WS_CLASS = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in PY_WHITESPACE) + "]+"


def _words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{_WS_CLASS}'), lambda w: w <> '')"


_BATCH = {
    "o_items": "SELECT change_set, pos, path, diff FROM v_diffs",
    "o_grp": f"""
SELECT *, length(diff) < {SM.SMALL_ITEM_CHARS} AS small,
       CASE WHEN length(diff) < {SM.SMALL_ITEM_CHARS}
            THEN 's' || CAST((row_number() OVER (PARTITION BY change_set, length(diff) < {SM.SMALL_ITEM_CHARS}
                                                 ORDER BY pos) - 1) // {SM.BATCH_SIZE} AS VARCHAR)
            ELSE 'l' || CAST(pos AS VARCHAR) END AS bid
FROM o_items""",
    "o_batch": f"""
SELECT change_set, bid, bool_and(small) AS small, count(*) AS n_items, max(pos) AS last_pos,
       string_agg(path, ',' ORDER BY pos) AS paths, sum(length(diff)) AS total_chars,
       CASE WHEN count(*) = 1 THEN min(diff)
            ELSE string_agg('File: ' || path || chr(10) || diff, chr(10) || '---' || chr(10) ORDER BY pos) END AS body
FROM o_grp GROUP BY change_set, bid""",
    "o_batches": f"""
SELECT *, row_number() OVER (PARTITION BY change_set ORDER BY small AND n_items < {SM.BATCH_SIZE}, last_pos) AS batch_no,
       replace({_lit(SM.FILE_PROMPT)}, '{{diff}}', body) AS prompt
FROM o_batch""",
    "o_results": f"""
SELECT change_set, batch_no, paths,
       CASE WHEN length(prompt) % {FAIL_MODULUS} <> 0
            THEN array_to_string({_words('prompt')}[1:{SUMMARY_WORDS}], ' ') END AS summary,
       CASE WHEN length(prompt) % {FAIL_MODULUS} = 0 THEN 'simulated model failure' END AS error
FROM o_batches""",
    "o_fold": """
SELECT s.change_set, f.summaries FROM (SELECT DISTINCT change_set FROM v_diffs) s LEFT JOIN (
  SELECT change_set, string_agg('- ' || replace(paths, ',', ', ') || ': ' || summary, chr(10) ORDER BY batch_no)
         AS summaries
  FROM o_results WHERE summary IS NOT NULL AND summary <> '' GROUP BY change_set) f ON f.change_set IS NOT DISTINCT FROM s.change_set""",
}


@register("size_batches", """
SELECT change_set, batch_no, CAST(n_items AS INTEGER) AS n_items, paths, CAST(total_chars AS BIGINT) AS total_chars
FROM o_batches""", _BATCH)
def q_size_batches(spark, sf_dir):
    b = SM.size_batches(V.v_diffs(Tables(spark, sf_dir)))
    return b.select("change_set", "batch_no", "n_items",
                    F.array_join(F.transform("members", lambda m: m["path"]), ",").alias("paths"),
                    F.aggregate("members", F.lit(0).cast("bigint"), lambda a, m: a + F.length(m["diff"]))
                    .alias("total_chars"))


def _results(spark, sf_dir):
    d = V.v_diffs(Tables(spark, sf_dir))
    return d, SM.map_batches(SM.size_batches(d), demo_summarizer)   # consumed once per query


@register("map_batches", "SELECT change_set, batch_no, paths AS files, summary, error FROM o_results", _BATCH)
def q_map_batches(spark, sf_dir):
    r = _results(spark, sf_dir)[1]
    return r.select("change_set", "batch_no", F.array_join("files", ",").alias("files"), "summary", "error")


@register("call_batches", "SELECT change_set, batch_no, paths AS files, summary, error FROM o_results", _BATCH)
def q_call_batches(spark, sf_dir):
    """I1 through a ledger that an earlier run, over the small batches, has begun."""
    ledger = scratch_folder(spark, "ledger")
    batches = SM.size_batches(V.v_diffs(Tables(spark, sf_dir))).checkpoint()
    call_batches(batches.where("is_small"), ledger, demo_summarizer)
    r = call_batches(batches, ledger, demo_summarizer)
    return r.select("change_set", "batch_no", F.array_join("files", ",").alias("files"), "summary", "error")


@register("fold_summaries", "SELECT change_set, summaries FROM o_fold", _BATCH)
def q_fold_summaries(spark, sf_dir):
    d, r = _results(spark, sf_dir)
    return SM.fold_summaries(r, change_sets=d)


@register("error_report", """
SELECT change_set, batch_no, paths AS files, error FROM o_results WHERE error IS NOT NULL""", _BATCH)
def q_error_report(spark, sf_dir):
    failed, _ = SM.error_report(_results(spark, sf_dir)[1])
    return failed.select("change_set", "batch_no", F.array_join("files", ",").alias("files"), "error")


@register("summarize_change_sets", f"""
SELECT f.change_set,
       CASE WHEN f.summaries IS NOT NULL
            THEN array_to_string({_words(f"replace({_lit(SM.COORDINATOR_PROMPT)}, '{{summaries}}', f.summaries)")}[-{SUMMARY_WORDS}:], ' ')
       END AS message,
       s.n_batches, s.n_failed
FROM o_fold f JOIN (SELECT change_set, count(*) AS n_batches, count(error) AS n_failed FROM o_results
                    GROUP BY change_set) s ON s.change_set IS NOT DISTINCT FROM f.change_set""", _BATCH)
def q_summarize_change_sets(spark, sf_dir):
    d = V.v_diffs(Tables(spark, sf_dir))
    out = SM.summarize_change_sets(d, demo_summarizer, demo_coordinator)
    return out.select("change_set", "message", "n_batches", "n_failed")


@register("render_prompt", f"""
SELECT change_set, pos, replace({_lit(SM.FILE_PROMPT)}, '{{diff}}', diff) AS prompt FROM v_diffs""")
def q_render_prompt(spark, sf_dir):
    from ..functions.text import render_template

    d = V.v_diffs(Tables(spark, sf_dir))
    return d.select("change_set", "pos", render_template(SM.FILE_PROMPT, diff=F.col("diff")).alias("prompt"))
