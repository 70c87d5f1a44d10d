"""Derived views that give each operator its natural input shape, computed by
Spark from the driver tables (so their size grows with the tables).

The same views exist as DuckDB SQL in ``repolens.plans.oracle_views`` for the
side-by-side correctness check; any change here must be mirrored there.

The dimension views derived from page references take an optional ``refs``
DataFrame so a caller that already extracted the references (once) can
derive them without re-scanning the pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import Tables

#: Generated source files that one task builds and parses at most.
FILES_PER_TASK = 20_000


def _s(c) -> Column:
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def _half(c: str) -> Column:
    # (k - k % 2) / 2 as BIGINT
    return ((F.col(c) - F.col(c) % 2) / 2).cast("bigint")


def v_files(t: Tables) -> DataFrame:
    """File corpus: ``doc_id, repo, path, content``."""
    d = t.documents
    k = F.col("doc_id")
    top = (F.when(k % 7 == 0, "venv").when(k % 7 == 1, "lib").when(k % 7 == 2, ".git")
           .otherwise(F.col("lang")))
    name = (F.when(k % 5 == 0, "__init__.py").when(k % 5 == 1, "mod.pyc")
            .when(k % 5 == 2, "secret.env.py").when(k % 5 == 3, "main.py")
            .otherwise("README.md"))
    path = F.concat(F.col("source"), F.lit("/"), top, F.lit("/p"), _s("doc_id"), F.lit("/"), name)
    return d.select("doc_id", F.col("source").alias("repo"), path.alias("path"),
                    F.col("text").alias("content"))


def v_repo_files(t: Tables) -> DataFrame:
    """Repository file list for test-location lookups: ``doc_id, path``."""
    k = F.col("doc_id")
    prefix = (F.when(k % 4 == 0, "pkg/test_m").when(k % 4 == 1, "pkg/tests/test_m")
              .when(k % 4 == 2, "tests/pkg/test_m").otherwise("tests/test_m"))
    path = (F.when(k % 3 == 0, F.concat(F.lit("pkg/m"), _s(k), F.lit(".py")))
            .when((k % 3 == 1) & (k % 9 != 1), F.concat(prefix, _s(k - 1), F.lit(".py")))
            .otherwise(F.concat(F.lit("docs/n"), _s(k), F.lit(".md"))))
    return t.documents.select("doc_id", path.alias("path"))


def v_refs(t: Tables) -> DataFrame:
    """Distinct ``(path, ref)``: first path component of every link of a page."""
    hrefs = t.pages.select(F.col("url").alias("path"),
                           F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"]+)"'), F.lit(1))).alias("h"))
    return (hrefs.select("path", F.regexp_extract("h", r"^/?([^/?#]+)", 1).alias("ref"))
            .where(F.col("ref") != "").distinct())


def v_edges(t: Tables) -> DataFrame:
    """Package dependency edges ``src, dst`` (BIGINT), with cycles and diamonds."""
    p = t.part
    a = p.where(F.col("p_partkey") > 0).select(F.col("p_partkey").alias("src"), _half("p_partkey").alias("dst"))
    b = p.select(F.col("p_partkey").alias("src"), F.col("p_size").cast("bigint").alias("dst"))
    return a.unionAll(b).where(F.col("src") != F.col("dst")).distinct()


def v_tree_edges(t: Tables) -> DataFrame:
    """Package edges whose branches end by themselves: each part requires its
    half, every third one also its quarter (diamonds), and every part from
    the 41st on whose number ends in 7 stands in a cycle of two with its half."""
    k = F.col("p_partkey")
    a = t.part.where(k > 1).select(k.alias("src"), _half("p_partkey").alias("dst"))
    b = t.part.where((k > 3) & (k % 3 == 0)).select(k.alias("src"), F.floor(k / 4).cast("bigint").alias("dst"))
    c = t.part.where((k > 40) & (k % 10 == 7)).select(_half("p_partkey").alias("src"), k.alias("dst"))
    return a.unionAll(b).unionAll(c).where((F.col("src") != F.col("dst")) & (F.col("dst") > 0)).distinct()


def v_dists(t: Tables) -> DataFrame:
    """Installed distributions: ``p_partkey, name, version, license, classifiers_txt``."""
    k = F.col("p_partkey")
    lic = (F.when(k % 4 == 0, "UNKNOWN").when(k % 4 == 1, F.lit(None).cast("string"))
           .when(k % 4 == 2, "").otherwise(F.col("p_type")))
    cls = (F.when(k % 3 == 0, F.concat(F.lit("Topic :: Tools|License :: OSI Approved :: "), F.col("p_brand")))
           .otherwise(F.lit("Topic :: Tools")))
    return t.part.select(
        "p_partkey",
        F.concat(F.regexp_replace("p_name", " ", "_"), F.lit("_"), _s("p_partkey")).alias("name"),
        _s("p_size").alias("version"), lic.alias("license"), cls.alias("classifiers_txt"))


def v_requires(t: Tables) -> DataFrame:
    """Requirement strings per distribution: ``p_partkey, pos, requirement``."""
    a = t.part.select("p_partkey", "p_size")
    b = t.part.select(F.col("p_partkey").alias("b_key"), F.col("p_name").alias("b_name"))
    r0 = (a.join(b.hint("merge"), b.b_key == _half("p_partkey"))
          .select("p_partkey", F.lit(0).alias("pos"),
                  F.concat(F.regexp_replace("b_name", " ", "_"), F.lit("_"), _s("b_key"),
                           F.lit("[extra]>=1.0")).alias("requirement")))
    r1 = (a.join(b.hint("merge"), b.b_key == F.col("p_size"))
          .select("p_partkey", F.lit(1).alias("pos"),
                  F.concat(F.upper(F.regexp_replace("b_name", " ", "-")), F.lit("-"), _s("b_key"),
                           F.lit(" <2")).alias("requirement")))
    r2 = t.part.select("p_partkey", F.lit(2).alias("pos"), F.lit("(invalid").alias("requirement"))
    return r0.unionByName(r1).unionByName(r2)


def v_tree_requires(t: Tables) -> DataFrame:
    """Requirement strings along ``v_tree_edges``: ``p_partkey, pos, requirement``."""
    n = v_dists(t).select(F.col("p_partkey").alias("dst"), "name")
    e = v_tree_edges(t).join(n.hint("merge"), "dst")
    return e.select(F.col("src").alias("p_partkey"), F.col("dst").alias("pos"), F.concat(F.upper("name"), F.lit(">=1.0")).alias("requirement"))


def v_apps(t: Tables) -> DataFrame:
    """Application modules: every 20th part's imports its distribution, every
    40th one also a package that is not installed: ``p_partkey, path, content``."""
    d = v_dists(t).where(F.col("p_partkey") % 20 == 0)
    nl = F.lit("\n")
    gone = F.when(F.col("p_partkey") % 40 == 0, F.concat(F.lit("from gone"), _s("p_partkey"), F.lit(" import x"), nl)).otherwise(F.lit(""))
    return d.select("p_partkey", F.concat(F.lit("app/a"), _s("p_partkey"), F.lit(".py")).alias("path"),
                    F.concat(F.lit("import os"), nl, F.lit("import "), F.col("name"), nl, gone).alias("content"))


def v_manifests(t: Tables) -> DataFrame:
    """One project manifest text per repository: ``repo_id, manifest``."""
    nl = F.lit("\n")
    m = F.concat(F.lit("[project]"), nl, F.lit("dependencies = ["), nl, F.lit('    "'),
                 F.regexp_replace("p_name", " ", "_"), F.lit('>=1",'), nl,
                 F.lit("    '"), F.col("p_type"), F.lit("',"), nl, F.lit("]"), nl,
                 F.lit('dev = ["'), F.regexp_replace("p_brand", "#", "-"), F.lit('"]'))
    return t.part.select(F.col("p_partkey").alias("repo_id"), m.alias("manifest"))


def v_calls(t: Tables) -> DataFrame:
    """Model call log: ``event_id, run, ts, seconds, event_type, usage_json``."""
    e = t.events.select("event_id", "user_id", "ts", "value", "event_type",
                        F.regexp_extract("props", "([0-9]+)", 1).alias("k"),
                        _s(F.col("event_id") % 50).alias("o"))
    k, o, et = F.col("k"), F.col("o"), F.col("event_type")
    usage = (F.when(et == "click", F.concat(F.lit('{"prompt_tokens":'), k, F.lit(',"completion_tokens":'), o,
                                            F.lit(',"details":{"cached":1}}')))
             .when(et == "view", F.concat(F.lit('{"input_tokens":'), k, F.lit(',"output_tokens":'), o, F.lit("}")))
             .when(et == "purchase", F.concat(F.lit('{"total_tokens":'), k, F.lit(',"completion_tokens":'), o,
                                              F.lit("}")))
             .when(et == "signup", F.concat(F.lit('{"prompt_tokens":0,"input_tokens":'), k,
                                            F.lit(',"completion_tokens":0,"output_tokens":'), o, F.lit("}"))))
    return e.select("event_id", F.col("user_id").alias("run"), "ts", F.col("value").alias("seconds"),
                    "event_type", usage.alias("usage_json"))


def v_decisions(t: Tables) -> DataFrame:
    """Permission decision log: ``session, seq, tool, choice``."""
    et, k = F.col("event_type"), F.col("event_id")
    tool = (F.when(et.isin("purchase", "signup"), "write_file").when(et == "error", "run_command")
            .when(et == "click", "read_file").otherwise("list_files"))
    choice = (F.when(k % 60 == 7, "always").when(k % 60 == 11, "session")
              .when(k % 3 == 0, "n").otherwise("y"))
    return t.events.select(F.col("user_id").alias("session"), k.alias("seq"), tool.alias("tool"),
                           choice.alias("choice"))


def v_chunks(t: Tables) -> DataFrame:
    """Streamed response fragments of 40 characters: ``response_id, seq, frag``."""
    c = t.conversations.where((F.col("role") == "assistant") & (F.length("text") > 0))
    c = c.select((F.col("conv_id") * 100 + F.col("turn")).alias("response_id"), "text",
                 F.explode(F.sequence(F.lit(1), F.length("text"), F.lit(40))).alias("s"))
    return c.select("response_id", ((F.col("s") + 39) / 40).cast("bigint").alias("seq"),
                    F.substring(F.col("text"), F.col("s"), F.lit(40)).alias("frag"))


def v_diffs(t: Tables) -> DataFrame:
    """Change sets: ``change_set, pos, path, diff``."""
    return t.documents.select(F.col("source").alias("change_set"), F.col("doc_id").alias("pos"),
                              F.concat(F.col("source"), F.lit("/p"), _s("doc_id")).alias("path"),
                              F.col("text").alias("diff"))


def v_layers(t: Tables) -> DataFrame:
    """Settings layers: ``priority, key_path, value`` (value BIGINT)."""
    pr = F.substring("o_orderpriority", 1, 1).cast("int")
    ck = F.col("o_custkey")
    key = F.concat(F.lit("c"), _s(ck),
                   F.when((ck + pr) % 4 == 0, F.lit(""))
                   .otherwise(F.concat(F.lit(".k"), _s(F.col("o_orderkey") % 5))))
    o = t.orders.select(pr.alias("priority"), "o_orderkey", key.alias("key_path"))
    return o.groupBy("priority", "key_path").agg(F.max("o_orderkey").alias("value"))


def v_declared(t: Tables, refs: DataFrame | None = None) -> DataFrame:
    r = (v_refs(t) if refs is None else refs).where(F.length("ref") % 2 == 0).select(F.col("ref").alias("name"))
    d = v_dists(t).where(F.col("p_partkey") < 20).select("name")
    return r.union(d).distinct()


def v_alias(t: Tables, refs: DataFrame | None = None) -> DataFrame:
    return ((v_refs(t) if refs is None else refs).where(F.col("ref") != F.lower("ref"))
            .select(F.col("ref").alias("alias"), F.lower("ref").alias("install_name")).distinct())


def v_ref_dists(t: Tables, refs: DataFrame | None = None) -> DataFrame:
    """Metadata for distributions that resolve page references:
    ``name, version, license, classifiers_txt``."""
    r = (v_refs(t) if refs is None else refs).where(F.length("ref") % 3 == 0)
    return (r.select(F.lower("ref").alias("name"),
                     F.concat(_s(F.length("ref")), F.lit(".0")).alias("version"),
                     F.when(F.length("ref") % 2 == 0, F.lit("MIT")).otherwise(F.lit(None).cast("string"))
                     .alias("license"),
                     F.when(F.length("ref") % 4 == 3, F.lit("License :: OSI Approved :: BSD License"))
                     .otherwise(F.lit("")).alias("classifiers_txt"))
            .distinct())


def v_ref_std(t: Tables, refs: DataFrame | None = None) -> DataFrame:
    return (v_refs(t) if refs is None else refs).where(F.length("ref") % 3 == 1).select(F.lower("ref").alias("name")).distinct()


def v_registry(t: Tables) -> DataFrame:
    """Tool registry: ``tool, param, required`` (a small dimension table)."""
    rows = [("click", "k", True), ("view", "k", False), ("purchase", "k", True),
            ("purchase", "amount", True), ("error", "code", False)]
    return t.spark.createDataFrame(rows, "tool string, param string, required boolean")


def v_code(t: Tables) -> DataFrame:
    """One small generated Python module per part: ``p_partkey, path, content``."""
    k = F.col("p_partkey")
    nl = F.lit("\n")
    content = F.concat(
        F.lit("import os, "), F.regexp_replace("p_name", " ", "_"), F.lit(".sub"), nl,
        F.lit("from "), F.lower("p_type"), F.lit(".core import x"), nl,
        F.lit("from . import rel"), nl,
        F.lit("class C"), _s(k), F.lit(":"), nl,
        F.lit("    def m1(self, a):"), nl,
        F.when(k % 2 == 0, F.concat(F.lit('        "doc"'), nl)).otherwise(F.lit("")),
        F.lit("        return a"), nl,
        F.lit("    async def m2(self):"), nl,
        F.lit("        pass"), nl,
        F.lit("def f"), _s(k % 50), F.lit("(x, y):"), nl,
        F.when(k % 3 == 0, F.concat(F.lit('    """Doc."""'), nl)).otherwise(F.lit("")),
        F.lit("    return x"), nl)
    # The keys are small and the texts built from them large: deal the keys.
    keys = t.part.select("p_partkey", "p_name", "p_type")
    tasks = max(t.spark.sparkContext.defaultParallelism, -(-keys.count() // FILES_PER_TASK))
    return keys.repartition(tasks, "p_partkey").select("p_partkey", F.concat(F.lit("pkg/c"), _s(k), F.lit(".py")).alias("path"),
                                                       content.alias("content"))


def v_event_lines(t: Tables) -> DataFrame:
    """Server-sent event lines of every assistant response, derived from the
    40-character fragments of ``v_chunks``: ``response_id, line_no, line``.

    Per response with ``n`` fragments: line 0 is a keep-alive comment; lines
    1..n carry the content deltas; when ``response_id % 3 = 0`` lines n+1 and
    n+2 stream one tool call in two pieces and, when ``response_id % 6 = 0``,
    line n+3 a second call; line n+4 is a partial usage record, line n+5 the
    final usage, line n+6 a malformed payload and line n+7 the end marker.
    """
    ch = v_chunks(t)
    n = ch.groupBy("response_id").agg(F.max("seq").alias("n"))
    rid = F.col("response_id")

    def line(obj):
        return F.concat(F.lit("data: "), F.to_json(obj))

    def choice(delta):
        return F.struct(F.array(F.struct(F.lit(0).alias("index"), delta.alias("delta"))).alias("choices"))

    def tool(index, name, args, id_=None):
        fields = [F.lit(index).alias("index")]
        if id_ is not None:
            fields.append(id_.alias("id"))
        fields.append(F.struct(F.lit(name).alias("name"), args.alias("arguments")).alias("function"))
        return choice(F.struct(F.array(F.struct(*fields)).alias("tool_calls")))

    def usage(p, c):
        return F.struct(F.array().cast("array<string>").alias("choices"),
                        F.struct(p.alias("prompt_tokens"), c.alias("completion_tokens")).alias("usage"))

    content = ch.select("response_id", F.col("seq").alias("line_no"),
                        line(choice(F.struct(F.col("frag").alias("content")))).alias("line"))
    n1 = F.col("n")

    def at(offset, text, cond=None):
        s = F.struct((n1 + offset).cast("bigint").alias("line_no"), text.alias("line"))
        return s if cond is None else F.when(cond, s)

    tail = F.array(
        F.struct(F.lit(0).cast("bigint").alias("line_no"), F.lit(": keep-alive").alias("line")),
        at(1, line(tool(0, "read_", F.lit('{"filepath": '), F.concat(F.lit("call_"), rid.cast("string")))), rid % 3 == 0),
        at(2, line(tool(0, "file", F.concat(F.lit('"p'), rid.cast("string"), F.lit('.py"}')))), rid % 3 == 0),
        at(3, line(tool(1, "list_files", F.lit("{}"), F.concat(F.lit("call_"), rid.cast("string"), F.lit("_b")))),
           rid % 6 == 0),
        at(4, line(usage(F.lit(5).cast("bigint"), F.lit(0).cast("bigint")))),
        at(5, line(usage((rid % 7) * 10, n1))),
        at(6, F.lit('data: {"choices": [')),
        at(7, F.lit("data: [DONE]")))
    extra = (n.select("response_id", F.explode(tail).alias("x")).where(F.col("x").isNotNull())
             .select("response_id", "x.line_no", "x.line"))
    return content.unionByName(extra)
