"""Change-set summarising.

Per-file diffs, cut (P6) only where a ``limit`` is given, are packed into batches by size in arrival
order (W1), rendered into prompts (P10), sent through a user-supplied
function one batch per call (I1), and the per-batch summaries are folded
into one prompt per change set for a second call (A5, I2).

Ordering never relies on row order: every ordinal is computed from an
explicit position column.  Ranks inside a change set are computed range by
range (``distributed_row_number``), so a change set holding a third of all
files is numbered by many tasks, not one window partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import PY_WHITESPACE, clean_fenced_text, render_template, truncate_text
from .ordered import ordered_concat

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's behaviour.
SMALL_ITEM_CHARS = 500   # items shorter than this are batched together
BATCH_SIZE = 3           # small items per batch
MAX_CONCURRENT = 4       # parallel calls per change set in the reference
# ---------------------------------------------------------------------------
# Prompts: this engine's own wording, replaceable by argument.
FILE_PROMPT = "In at most fifteen words, say what this change does and what it is for:\n\n{diff}"
COORDINATOR_PROMPT = ("Write one commit message for the changes below: a short title in the imperative, an empty line, "
                      "then one bullet per change that matters.\n\n{summaries}")


def distributed_row_number(df: DataFrame, keys, order_col: str, out_col: str = "rn") -> DataFrame:
    """``row_number()`` over ``partitionBy(keys).orderBy(order_col)``,
    computed without one partition per key: rows are dealt to ranges of (key,
    order) and written once; a key's offset in a range is the number of its
    rows in earlier ranges (a running sum over at most one row per range),
    and the final number is the offset plus the rank inside the range.  Null
    keys are a key, null orders come first.  Pass narrow rows."""
    keys = list(keys)
    d = df.repartitionByRange(*keys, order_col).withColumn("_bk", F.spark_partition_id()).checkpoint(eager=True)
    counts = d.groupBy(*keys, "_bk").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    offsets = offsets.withColumnsRenamed({k: f"_{k}_" for k in [*keys, "_bk"]})
    same = [F.col(k).eqNullSafe(F.col(f"_{k}_")) for k in [*keys, "_bk"]]
    inner = Window.partitionBy(*keys, "_bk").orderBy(order_col)
    return (d.withColumn(out_col, F.row_number().over(inner)).join(offsets, reduce(lambda a, b: a & b, same))
            .withColumn(out_col, F.col("_off") + F.col(out_col)).select(*df.columns, out_col))


def size_batches(diffs: DataFrame, key: str = "change_set", pos_col: str = "pos", path_col: str = "path",
                 diff_col: str = "diff", limit: int | None = None, small_chars: int = SMALL_ITEM_CHARS,
                 batch_size: int = BATCH_SIZE) -> DataFrame:
    """Items shorter than ``small_chars`` (measured after the cut at
    ``limit`` and its marker, if one is given; a null diff is an empty one)
    are grouped ``batch_size`` at a time in arrival order; larger
    items form a batch alone.  Batches are numbered in the order a
    sequential pass emits them: a full small batch when its last member
    arrives, a large item when it arrives, the leftover small batch last.

    Output ``key, batch_no, n_items, is_small, members
    ARRAY<STRUCT<pos, path, diff>>`` (members in arrival order).  A null key
    is a change set of its own.  Rows of one position come in the order of
    their paths and texts' hashes; repeated rows are items each.  Numbering
    works on thin rows; texts are joined once, at the end, one text for all
    rows that are alike.
    """
    text = F.coalesce(F.col(diff_col), F.lit(""))
    d = diffs.select(F.col(key).alias("key"), F.col(pos_col).alias("pos"), F.col(path_col).alias("path"),
                     (truncate_text(text, limit) if limit else text).alias("diff"))
    # What tells an item's text; equal structs are equal in their nulls too.
    d = d.withColumn("item", F.struct("key", "pos", "path", F.xxhash64("diff").alias("h")))
    thin = d.select("item", "key", F.struct("pos", "path", "item.h").alias("at"), (F.length("diff") < small_chars).alias("small"))
    small = distributed_row_number(thin.where("small"), ["key"], "at", "rn")
    small = small.withColumn("grp", F.floor((F.col("rn") - 1) / batch_size)).drop("rn")
    large = thin.where(~F.col("small")).withColumn("grp", F.lit(None).cast("bigint"))
    # A large item is told by its row number: the rows are written once.
    items = small.unionByName(large).withColumn("row", F.when(F.col("grp").isNull(), F.monotonically_increasing_id())).checkpoint(eager=True)
    batches = items.groupBy("key", "grp", "row").agg(F.max("at").alias("last"), F.count("*").cast("int").alias("n_items"))
    leftover = F.col("grp").isNotNull() & (F.col("n_items") < batch_size)
    batches = batches.select("key", "grp", "row", "n_items", F.struct(leftover.alias("leftover"), "last", "row").alias("emitted"))
    numbered = distributed_row_number(batches, ["key"], "emitted", "batch_no")
    b = numbered.select(F.col("key").alias("b_key"), F.col("grp").alias("b_grp"), F.col("row").alias("b_row"), "n_items", "batch_no")
    placed = items.join(b, F.col("key").eqNullSafe(F.col("b_key")) & F.col("grp").eqNullSafe(F.col("b_grp")) & F.col("row").eqNullSafe(F.col("b_row")))
    texts = d.groupBy("item").agg(F.first("diff").alias("diff"))
    whole = placed.select("item", "small", "n_items", "batch_no").join(texts, "item")
    return (whole.groupBy(F.col("item.key").alias("key"), "batch_no")
            .agg(F.first("n_items").alias("n_items"), F.first("small").alias("is_small"),
                 F.array_sort(F.collect_list(F.struct("item.pos", "item.path", "diff"))).alias("members"))
            .select(F.col("key").alias(key), "batch_no", "n_items", "is_small", "members"))


def batch_prompt(template: str = FILE_PROMPT):
    """P10 for batches: one item -> the template with its diff; several ->
    ``File: <path>\\n<diff>`` blocks joined by ``\\n---\\n``."""
    combined = F.array_join(F.transform("members", lambda m: F.concat(F.lit("File: "), m["path"], F.lit("\n"),
                                                                      m["diff"])), "\n---\n")
    body = F.when(F.col("n_items") == 1, F.col("members")[0]["diff"]).otherwise(combined)
    return render_template(template, diff=body)


def first_words(text: str, n: int = 15) -> str:
    """The deterministic summariser shipped with the engine: first ``n``
    whitespace-separated words of the prompt."""
    return " ".join(text.split()[:n])


def _call_batches(fn: Callable[[str], str], keys: list[str]):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            summaries, errors = [], []
            for prompt in pdf["prompt"]:
                try:
                    out = fn(prompt)
                    summaries.append(out.strip(PY_WHITESPACE) if out is not None else None)
                    errors.append(None)
                except Exception as e:  # noqa: BLE001 -- a failed call is a value
                    summaries.append(None)
                    errors.append(str(e))
            res = pdf[keys].copy()
            res["summary"] = summaries
            res["error"] = errors
            yield res
    return run


def map_batches(batches: DataFrame, fn: Callable[[str], str] = first_words, template: str = FILE_PROMPT,
                key: str = "change_set", max_concurrent: int | None = None) -> DataFrame:
    """One call of ``fn`` per batch; a failure becomes an ``error`` value
    on that row, never a failed job.  The result is lazy: a caller that
    consumes it more than once should ``checkpoint()`` it so the function
    is not called again.  ``max_concurrent`` bounds the simultaneous
    calls of one change set: its batches are dealt to so many slots, each in
    one partition; by default Spark's parallelism applies.  Only the prompt and keys cross into Python (Arrow batches)."""
    b = batches.select(key, "batch_no", F.transform("members", lambda m: m["path"]).alias("files"),
                       batch_prompt(template).alias("prompt"))
    if max_concurrent:
        b = b.withColumn("_slot", F.col("batch_no") % max_concurrent).repartition(key, "_slot").drop("_slot")
    keys = [key, "batch_no", "files"]
    schema = f"`{key}` {b.schema[key].dataType.simpleString()}, batch_no bigint, files array<string>, " \
             "summary string, error string"
    return b.mapInPandas(_call_batches(fn, keys), schema)


def _join_null_safe(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join on ``key``, where a null key is a key of its own."""
    r = right.withColumnRenamed(key, "_right_key")
    return left.join(r, left[key].eqNullSafe(r["_right_key"]), "left").drop("_right_key")


def fold_summaries(results: DataFrame, key: str = "change_set", change_sets: DataFrame | None = None) -> DataFrame:
    """A5: drop results with an empty summary; per change set, lines
    ``- f1, f2: summary`` in batch order joined by newlines; null when no
    summary remains (for change sets listed in ``change_sets``)."""
    ok = results.where(F.col("summary").isNotNull() & (F.col("summary") != ""))
    lines = ok.select(key, "batch_no", F.concat(F.lit("- "), F.array_join("files", ", "), F.lit(": "),
                                                 F.col("summary")).alias("line"))
    folded = ordered_concat(lines, [key], "batch_no", "line", sep="\n", out_col="summaries")
    if change_sets is not None:
        folded = _join_null_safe(change_sets.select(key).distinct(), folded, key)
    return folded


def error_report(results: DataFrame, key: str = "change_set") -> tuple[DataFrame, DataFrame]:
    """Failed batches with their files and error, and the count per
    change set."""
    failed = results.where(F.col("error").isNotNull()).select(key, "batch_no", "files", "error")
    counts = failed.groupBy(key).agg(F.count("*").alias("n_failed"))
    return failed, counts


def _call_fold(fn: Callable[[str], str], key: str):
    def run(it):
        for pdf in it:
            msgs, errs = [], []
            for p in pdf["prompt"]:
                if p is None:
                    msgs.append(None)
                    errs.append(None)
                    continue
                try:
                    msgs.append(fn(p))
                    errs.append(None)
                except Exception as e:  # noqa: BLE001
                    msgs.append(None)
                    errs.append(str(e))
            res = pdf[[key]].copy()
            res["raw_message"] = msgs
            res["error"] = errs
            yield res
    return run


def summarize_change_sets(diffs: DataFrame, fn: Callable[[str], str] = first_words,
                          coordinator_fn: Callable[[str], str] | None = None, key: str = "change_set",
                          file_prompt: str = FILE_PROMPT, coordinator_prompt: str = COORDINATOR_PROMPT,
                          max_concurrent: int | None = None, limit: int | None = None, ledger: str | None = None) -> DataFrame:
    """(cut at ``limit``, if given) -> batch -> per-batch call -> fold -> one coordinator
    call per change set -> strip code fences.  Output ``key, message,
    n_batches, n_failed, error``; ``message`` is null when no batch produced
    a summary.  With a ``ledger`` folder the batches' calls are not repeated by
    a later run (see ``calls.call_batches``)."""
    coordinator_fn = coordinator_fn or fn
    batches = size_batches(diffs, key, limit=limit)
    # The per-batch results feed two branches (the fold and the stats): call
    # the user's function once per batch and keep the answers (reliable
    # checkpoint in the shared folder), instead of calling it twice.
    if ledger is not None:
        from .calls import call_batches

        bound = max_concurrent or MAX_CONCURRENT
        results = call_batches(batches, ledger, fn, file_prompt, key, bound, min(2, bound)).checkpoint(eager=True)
    else:
        results = map_batches(batches, fn, file_prompt, key, max_concurrent).checkpoint(eager=True)
    sets = diffs.select(key).distinct()
    folded = fold_summaries(results, key, sets)
    prompts = folded.select(key, F.when(F.col("summaries").isNotNull(),
                                        render_template(coordinator_prompt, summaries=F.col("summaries")))
                            .alias("prompt"))
    schema = f"`{key}` {prompts.schema[key].dataType.simpleString()}, raw_message string, error string"
    msgs = prompts.mapInPandas(_call_fold(coordinator_fn, key), schema)
    stats = results.groupBy(key).agg(F.count("*").alias("n_batches"),
                                     F.count_if(F.col("error").isNotNull()).alias("n_failed"))
    out = _join_null_safe(msgs, stats, key)
    return out.select(key, clean_fenced_text("raw_message").alias("message"), "n_batches", "n_failed", "error")
