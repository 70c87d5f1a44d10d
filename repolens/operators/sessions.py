"""Assistant-session logs and path lookups.

Per-session or per-conversation state is computed with aggregates joined
back on the key (partial/final aggregation, AQE skew joins) rather than
windows partitioned by the key, so one very long session is still spread
over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions._util import col
from ..functions.text import history_preview, sanitize_docstring, WORD_CLASS
from .ordered import ordered_concat

# Fixed values that must equal the reference's behaviour.
# Tools that need the user's permission.
SENSITIVE_TOOLS = ["write_file", "replace_file_content", "multi_replace_file_content", "run_command"]
# Choices that allow the call; "always" and "session" also make it sticky
# for that tool for the rest of the session.
ALLOW_CHOICES = ["y", "always", "session"]
STICKY_CHOICES = ["always", "session"]
# Context block injected for an @mention of an existing file.
CONTEXT_HEADER_START = "\n--- Context from "
CONTEXT_HEADER_END = " ---\n"
CONTEXT_FOOTER = "\n---------------------------------\n"
# Test-file suggestion prefix.
TEST_PREFIX = "test_"


def sticky_permissions(log: DataFrame, session_col: str = "session", seq_col: str = "seq",
                       tool_col: str = "tool", choice_col: str = "choice", sensitive=None) -> DataFrame:
    """Per request, whether the tool call is allowed and whether the user
    was asked.  Non-sensitive tools are always allowed unasked; once a
    sensitive tool was answered ``always`` or ``session`` in a session, later
    calls of that same tool are allowed unasked; otherwise ``y`` allows and
    anything else denies.  The first sticky answer per (session, tool) is an
    aggregate joined back, not a running window.  A null session is a session."""
    sens = SENSITIVE_TOOLS if sensitive is None else list(sensitive)
    d = log.select(F.col(session_col).alias("session"), F.col(seq_col).alias("seq"),
                   F.col(tool_col).alias("tool"), F.col(choice_col).alias("choice"))
    is_sens = F.col("tool").isin(*sens)
    first = (d.where(is_sens & F.col("choice").isin(*STICKY_CHOICES))
             .groupBy(F.col("session").alias("s_session"), F.col("tool").alias("s_tool")).agg(F.min("seq").alias("sticky_from")))
    j = d.join(first, F.col("session").eqNullSafe(F.col("s_session")) & (F.col("tool") == F.col("s_tool")), "left")
    sticky = F.coalesce(F.col("sticky_from") < F.col("seq"), F.lit(False))
    asked = is_sens & ~sticky
    allowed = ~is_sens | sticky | F.coalesce(F.col("choice").isin(*ALLOW_CHOICES), F.lit(False))
    return j.select("session", "seq", "tool", "choice", allowed.alias("allowed"), asked.alias("asked"))


def reset_context(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Keep only the first message of each conversation (``min_by`` is a
    partial/final aggregate, so a long conversation is not one task)."""
    others = [c for c in messages.columns if c not in (conv_col,)]
    first = messages.groupBy(conv_col).agg(F.min_by(F.struct(*others), F.col(turn_col)).alias("m"))
    return first.select(conv_col, *[F.col("m")[c].alias(c) for c in others])


def history(messages: DataFrame, role_col: str = "role", content_col: str = "text",
            tool_calls_col: str | None = None, keep=("conv_id", "turn")) -> DataFrame:
    """One preview line per message."""
    return messages.select(*keep, history_preview(role_col, content_col, tool_calls_col).alias("preview"))


def _token_pattern() -> str:
    return rf"@[{WORD_CLASS}./-]+|[^@]+|@"


def inject_mentions(texts: DataFrame, files: DataFrame, key_col: str = "doc_id", text_col: str = "text",
                    path_col: str = "path", content_col: str = "content") -> DataFrame:
    """Replace every ``@path`` naming an existing file by a delimited
    context block with the file's content; other text is kept as is.

    Texts without ``@`` pass straight through.  The others are tokenised
    losslessly (``@name`` | run without ``@`` | lone ``@``), the name tokens
    are left-joined to the file table and the text is re-folded in token
    order.  Rows that share a key stay rows of their own: each different text
    of a key is folded once and given as often as it comes.  Of several
    contents of one path the smallest counts."""
    t = texts.select(F.col(key_col).alias("_k"), F.col(text_col).alias("_t"))
    plain = t.where(~F.contains(F.coalesce("_t", F.lit("")), F.lit("@")))
    withat = t.where(F.contains("_t", F.lit("@")))
    withat = withat.groupBy("_k", "_t").agg(F.count("*").cast("int").alias("_n")).withColumn("_h", F.sha2("_t", 256))
    toks = withat.select("_k", "_h", "_n", F.posexplode(F.regexp_extract_all("_t", F.lit(_token_pattern()), F.lit(0)))
                         .alias("pos", "tok"))
    toks = toks.withColumn("mention", F.when(F.col("tok").rlike(rf"^@[{WORD_CLASS}./-]+$"), F.substring("tok", 2, 1 << 30)))
    f = files.groupBy(F.col(path_col).alias("mention")).agg(F.min(content_col).alias("_c"))
    j = toks.join(f, "mention", "left")
    block = F.concat(F.lit(CONTEXT_HEADER_START), F.col("mention"), F.lit(CONTEXT_HEADER_END), F.col("_c"),
                     F.lit(CONTEXT_FOOTER))
    j = j.select("_k", "_h", "_n", "pos", F.when(F.col("_c").isNotNull(), block).otherwise(F.col("tok")).alias("piece"))
    folded = ordered_concat(j, ["_k", "_h", "_n"], "pos", "piece", out_col="_t")
    folded = folded.select("_k", "_t", F.explode(F.array_repeat(F.lit(0), F.col("_n"))).alias("_copy")).drop("_copy")
    out = plain.unionByName(folded)
    return out.select(F.col("_k").alias(key_col), F.col("_t").alias(text_col))


def test_candidates(path) -> Column:
    """Candidate test paths, in lookup order: sibling, sibling ``tests/``,
    ``tests/<parent>/``, ``tests/`` (relative paths)."""
    p = col(path)
    parts = F.split(p, "/")
    name = F.element_at(parts, -1)
    parent = F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")
    tname = F.concat(F.lit(TEST_PREFIX), name)

    def join(*xs):
        return F.concat_ws("/", *[F.when(x != "", x) for x in xs])

    return F.array(join(parent, tname), join(parent, F.lit("tests"), tname),
                   join(F.lit("tests"), parent, tname), join(F.lit("tests"), tname))


def test_coverage(sources: DataFrame, files: DataFrame, path_col: str = "path") -> DataFrame:
    """Per source file, the first existing candidate test file, else a
    suggested ``tests/test_<name>`` path."""
    s = sources.select(F.col(path_col).alias("source")).distinct()
    cand = s.select("source", F.posexplode(test_candidates("source")).alias("pos", "cand"))
    f = files.select(F.col(path_col).alias("cand")).distinct().withColumn("_hit", F.lit(True))
    hits = (cand.join(f, "cand", "inner").groupBy("source").agg(F.min_by("cand", "pos").alias("found")))
    out = s.join(hits, "source", "left")
    suggested = F.concat(F.lit("tests/" + TEST_PREFIX), F.element_at(F.split("source", "/"), -1))
    return out.select("source", F.col("found").isNotNull().alias("exists"),
                      F.coalesce("found", suggested).alias("path"))


#: Characters of a gram that paths are searched by.
GRAM = 3


def _grams(text, n: int) -> Column:
    """Distinct substrings of length ``n`` (``n = 0``: the empty string)."""
    t = col(text)
    if n == 0:
        return F.array(F.lit(""))
    L = F.length(t)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(L - n + 1, F.lit(1))),
                                        lambda i: F.substring(t, i, n)))


def _path_grams(files: DataFrame, lengths, *cols) -> DataFrame:
    """``cols`` and ``gram`` for each distinct gram of the lower-cased path."""
    grams = F.array_distinct(F.flatten(F.array(*[_grams("low", n) for n in lengths])))
    return files.select(*cols, F.explode(grams).alias("gram"))


def _gram_lengths(queries: DataFrame) -> list[int]:
    """Lengths of the grams that ``queries`` need: at most 0, 1, 2 and 3."""
    rows = queries.select(F.least(F.length("query"), F.lit(GRAM)).alias("n")).distinct().collect()
    return sorted(r["n"] for r in rows if r["n"] is not None) or [GRAM]


def rarest_grams(files: DataFrame, queries: DataFrame, lengths: list[int]) -> DataFrame:
    """``query, gram, n``: for each query the one of its grams (three
    characters; a shorter query whole) that the fewest paths ``low`` hold, and
    how many do.  A query with a gram that no path holds has no row: nothing
    contains it."""
    own = F.when(F.length("query") < GRAM, F.array("query")).otherwise(_grams("query", GRAM))
    q = queries.select("query", F.explode(own).alias("gram"))
    held = _path_grams(files, lengths).join(q.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    best = q.join(held, "gram", "left").groupBy("query").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("b"))
    return best.where(F.col("b.n") > 0).select("query", "b.gram", "b.n")


def path_search(files: DataFrame, queries: DataFrame, k: int, path_col: str = "path",
                query_col: str = "query") -> DataFrame:
    """Per query (lower-cased), the files whose name starts with it or
    whose path contains it -- a name is a suffix of its path, so this is
    "path contains query" -- ranked by number of components of ``@path``,
    then lower-cased path (then path), top ``k``.

    Containment is an equi join of each query's rarest gram (see
    ``rarest_grams``) with the grams of every path -- no nested-loop join --
    followed by the exact check, so a gram that all paths hold joins only for
    queries that have no other.  Only gram lengths that the queries have are
    made.  The per-query top-k is ``row_number() <= k``, which Spark plans with
    a partial group limit before the shuffle, so a query matching every file
    still ships at most ``k`` rows per map task.
    """
    from pyspark.sql import Window

    f = files.select(F.concat(F.lit("@"), F.col(path_col)).alias("option")).distinct()
    f = f.withColumn("low", F.lower(F.substring("option", 2, 1 << 30)))
    f = f.withColumn("ncomp", F.size(F.split("option", "/")))
    q = queries.select(F.lower(F.col(query_col)).alias("query")).distinct()
    lengths = _gram_lengths(q)
    best = rarest_grams(f, q, lengths).select("query", "gram")
    cand = (_path_grams(f, lengths, "option", "low", "ncomp").join(best, "gram")
            .where(F.contains("low", "query")).select("query", "option", "low", "ncomp"))
    w = Window.partitionBy("query").orderBy("ncomp", "low", "option")
    ranked = cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query", "rank", "option")


def fill_missing(methods: DataFrame, existing: DataFrame, generated: Column, key_col: str = "doc_id",
                 existing_col: str = "docstring", overwrite: bool = False) -> DataFrame:
    """Keep an existing docstring, generate one only where it is missing;
    with ``overwrite`` a new one is put in front and the old one kept.
    ``generated`` is a Column over ``methods`` (sanitised: triple quotes and
    single quotes removed).  Every row of ``methods`` gives one row; of several
    existing docstrings of a key the smallest that is not empty counts, and a
    null key has none."""
    m = methods.withColumn("_gen", sanitize_docstring(generated))
    e = existing.groupBy(key_col).agg(F.min(F.when(F.col(existing_col) != "", F.col(existing_col))).alias("_old"))
    j = m.join(e, key_col, "left")
    has = F.col("_old").isNotNull() & (F.col("_old") != "")
    if overwrite:
        doc = F.when(has, F.concat_ws("\n", F.col("_gen"), F.col("_old"))).otherwise(F.col("_gen"))
        action = F.when(has, F.lit("prepended")).otherwise(F.lit("generated"))
    else:
        doc = F.when(has, F.col("_old")).otherwise(F.col("_gen"))
        action = F.when(has, F.lit("kept")).otherwise(F.lit("generated"))
    return j.select(key_col, doc.alias("docstring"), action.alias("action"))
