"""Registered queries: settings layers and assistant-session logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import extract_mentions
from ..operators import sessions as SS
from ..operators import settings as S
from ..operators.nested import merge_nested
from ..sources import corpus as C
from ..sources import views as V
from ..sources.tables import Tables
from .registry import register
from .sqlparts import sql_list

# --- settings ----------------------------------------------------------------

_MERGED = {
    "o_merged": """
SELECT l.priority, l.key_path, l.value FROM v_layers l
WHERE NOT EXISTS (SELECT 1 FROM v_layers m WHERE m.priority > l.priority AND (
        m.key_path = l.key_path
     OR starts_with(l.key_path, m.key_path || '.')
     OR starts_with(m.key_path, l.key_path || '.')))"""}


@register("layered_overrides", "SELECT priority, key_path, value FROM o_merged", _MERGED)
def q_layered_overrides(spark, sf_dir):
    return S.layered_overrides(V.v_layers(Tables(spark, sf_dir)))


# Nested layers: a stack of JSON documents per customer, one per order priority,
# in five shapes that replace each other's scalars, arrays and subtrees.
_SHAPES = ('{"a":@hi}', '{"a":{"b":@hi,"c":{"d":@lo}}}', '{"a":{},"e":{"f":{}}}', '{"a":{"c":@hi},"x.y":@lo,"list":[@lo,{"q":1}]}',
           '{"a":{"c":{},"b":{"e":"t@lo"}},"e":null}')


def _shape_sql(shape: str) -> str:
    return "replace(replace('" + shape + "', '@hi', CAST(hi AS VARCHAR)), '@lo', CAST(lo AS VARCHAR))"


_NESTED = {
    "o_docs": f"""
SELECT stack, priority, CASE (stack + priority) % 5 {" ".join(f"WHEN {i} THEN {_shape_sql(x)}" for i, x in enumerate(_SHAPES))} END AS settings
FROM (SELECT o_custkey AS stack, CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority, max(o_orderkey) AS hi, min(o_orderkey) AS lo
      FROM orders GROUP BY ALL) o""",
    "o_open": """
WITH RECURSIVE t(stack, priority, path, v) AS (
  SELECT stack, priority, '', CAST(settings AS JSON) FROM o_docs
  UNION ALL
  SELECT stack, priority, CASE WHEN path = '' THEN '' ELSE path || '.' END || replace(replace(k, '%', '%25'), '.', '%2E'), json_extract(v, '$."' || k || '"')
  FROM (SELECT stack, priority, path, v, unnest(json_keys(v)) AS k FROM t WHERE json_type(v) = 'OBJECT') x)
SELECT stack, priority, path AS key_path, CAST(v AS VARCHAR) AS value FROM t WHERE path <> '' AND (json_type(v) <> 'OBJECT' OR CAST(v AS VARCHAR) = '{}')""",
    "o_left": """
SELECT * FROM o_open l WHERE NOT EXISTS (
  SELECT 1 FROM o_open m WHERE m.stack = l.stack AND m.priority > l.priority AND (
    m.key_path = l.key_path OR (m.value <> '{}' AND starts_with(l.key_path, m.key_path || '.'))
    OR (l.value <> '{}' AND starts_with(m.key_path, l.key_path || '.'))))""",
}


@register("nested_overrides", """
SELECT stack, priority, key_path, value FROM o_left l WHERE value <> '{}' OR NOT EXISTS (
  SELECT 1 FROM o_left m WHERE m.stack = l.stack AND starts_with(m.key_path, l.key_path || '.'))""", _NESTED)
def q_nested_overrides(spark, sf_dir):
    """J8 on nested documents, a stack of layers per customer."""
    o = Tables(spark, sf_dir).orders.groupBy(F.col("o_custkey").alias("stack"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority")) \
        .agg(F.max("o_orderkey").cast("string").alias("hi"), F.min("o_orderkey").cast("string").alias("lo"))
    text = F.lit(None).cast("string")
    for i, shape in enumerate(_SHAPES):
        text = F.when((F.col("stack") + F.col("priority")) % 5 == i, F.replace(F.replace(F.lit(shape), F.lit("@hi"), "hi"), F.lit("@lo"), "lo")).otherwise(text)
    return merge_nested(o.select("stack", "priority", text.alias("settings")), ["stack"])


# Secret-key pattern for the settings view (the driver's keys have no
# ``providers.*.api_key`` leaves): every ``.k0`` leaf counts as a secret.
SECRET_PATTERN = r"^c[0-9]+\.k0$"


@register("redact_settings", """
SELECT priority, key_path, value FROM v_layers WHERE NOT regexp_matches(key_path, '^c[0-9]+\\.k0$')""")
def q_redact_settings(spark, sf_dir):
    kept, _ = S.redact_settings(V.v_layers(Tables(spark, sf_dir)), pattern=SECRET_PATTERN)
    return kept


@register("redact_report", """
SELECT priority, count(*) AS n_removed FROM v_layers WHERE regexp_matches(key_path, '^c[0-9]+\\.k0$')
GROUP BY priority""")
def q_redact_report(spark, sf_dir):
    _, report = S.redact_settings(V.v_layers(Tables(spark, sf_dir)), pattern=SECRET_PATTERN)
    return report


@register("lookup_by_path", """
WITH req AS (
  SELECT DISTINCT key_path FROM (
    SELECT key_path FROM v_layers
    UNION ALL SELECT split_part(key_path, '.', 1) FROM v_layers
    UNION ALL SELECT key_path || '.missing' FROM v_layers) x),
inner_keys AS (SELECT DISTINCT split_part(key_path, '.', 1) AS key_path FROM o_merged WHERE contains(key_path, '.'))
SELECT r.key_path,
       CASE WHEN m.key_path IS NOT NULL THEN CAST(m.value AS VARCHAR)
            WHEN i.key_path IS NOT NULL THEN NULL ELSE 'none' END AS value,
       m.key_path IS NOT NULL OR i.key_path IS NOT NULL AS found,
       m.key_path IS NULL AND i.key_path IS NOT NULL AS is_subtree
FROM req r LEFT JOIN o_merged m ON m.key_path = r.key_path LEFT JOIN inner_keys i ON i.key_path = r.key_path""",
          _MERGED)
def q_lookup_by_path(spark, sf_dir):
    layers = V.v_layers(Tables(spark, sf_dir))
    merged = S.layered_overrides(layers)
    k = F.col("key_path")
    req = (layers.select(k).unionAll(layers.select(F.split(k, r"\.").getItem(0).alias("key_path")))
           .unionAll(layers.select(F.concat(k, F.lit(".missing")).alias("key_path"))).distinct()
           .withColumn("default", F.lit("none")))
    return S.lookup_by_path(merged, req)


# --- sessions -------------------------------------------------------------------


@register("sticky_permissions", f"""
WITH d AS (SELECT *, tool IN {sql_list(SS.SENSITIVE_TOOLS)} AS sens FROM v_decisions),
f AS (SELECT session, tool, min(seq) AS sticky_from FROM d WHERE sens AND choice IN ('always', 'session')
      GROUP BY session, tool)
SELECT d.session, d.seq, d.tool, d.choice,
       NOT d.sens OR coalesce(f.sticky_from < d.seq, false) OR d.choice IN ('y', 'always', 'session') AS allowed,
       d.sens AND NOT coalesce(f.sticky_from < d.seq, false) AS asked
FROM d LEFT JOIN f ON f.session = d.session AND f.tool = d.tool""")
def q_sticky_permissions(spark, sf_dir):
    return SS.sticky_permissions(V.v_decisions(Tables(spark, sf_dir)))


@register("reset_context", """
SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1""")
def q_reset_context(spark, sf_dir):
    return SS.reset_context(Tables(spark, sf_dir).conversations)


_MENTION_FILES = {
    "o_mfiles": """
SELECT DISTINCT m AS path, 'content of ' || m AS content FROM (
  SELECT unnest(regexp_extract_all(text, '@([\\p{L}\\p{N}_./-]+)', 1)) AS m FROM documents) x
WHERE length(m) % 2 = 0"""}


def _mention_files(docs):
    m = docs.select(F.explode(extract_mentions("text")).alias("path")).distinct()
    return m.where(F.length("path") % 2 == 0).select("path", F.concat(F.lit("content of "), F.col("path")).alias("content"))


@register("inject_mentions", """
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '@[\\p{L}\\p{N}_./-]+|[^@]+|@', 0)) AS tok,
         unnest(range(len(regexp_extract_all(text, '@[\\p{L}\\p{N}_./-]+|[^@]+|@', 0)))) AS pos
  FROM documents WHERE contains(text, '@'))
SELECT doc_id, text FROM documents WHERE NOT contains(coalesce(text, ''), '@')
UNION ALL
SELECT t.doc_id, string_agg(CASE WHEN f.path IS NOT NULL
    THEN chr(10) || '--- Context from ' || f.path || ' ---' || chr(10) || f.content || chr(10)
         || '---------------------------------' || chr(10)
    ELSE t.tok END, '' ORDER BY t.pos) AS text
FROM t LEFT JOIN o_mfiles f ON regexp_matches(t.tok, '^@[\\p{L}\\p{N}_./-]+$') AND f.path = substr(t.tok, 2)
GROUP BY t.doc_id""", _MENTION_FILES)
def q_inject_mentions(spark, sf_dir):
    d = Tables(spark, sf_dir).documents
    return SS.inject_mentions(d.select("doc_id", "text"), _mention_files(d))


@register("test_coverage", """
WITH s AS (SELECT DISTINCT path AS source FROM v_repo_files
           WHERE path LIKE '%.py' AND NOT starts_with(string_split(path, '/')[-1], 'test_')),
c AS (SELECT source, unnest([
        concat_ws('/', nullif(array_to_string(string_split(source, '/')[1:-2], '/'), ''), 'test_' || string_split(source, '/')[-1]),
        concat_ws('/', nullif(array_to_string(string_split(source, '/')[1:-2], '/'), ''), 'tests', 'test_' || string_split(source, '/')[-1]),
        concat_ws('/', 'tests', nullif(array_to_string(string_split(source, '/')[1:-2], '/'), ''), 'test_' || string_split(source, '/')[-1]),
        concat_ws('/', 'tests', 'test_' || string_split(source, '/')[-1])]) AS cand,
        unnest([0, 1, 2, 3]) AS pos FROM s),
h AS (SELECT source, arg_min(cand, pos) AS found FROM c WHERE cand IN (SELECT path FROM v_repo_files) GROUP BY source)
SELECT s.source, h.found IS NOT NULL AS exists, coalesce(h.found, 'tests/test_' || string_split(s.source, '/')[-1]) AS path
FROM s LEFT JOIN h USING (source)""")
def q_test_coverage(spark, sf_dir):
    files = V.v_repo_files(Tables(spark, sf_dir))
    name = F.element_at(F.split("path", "/"), -1)
    sources = files.where(F.col("path").endswith(".py") & ~name.startswith("test_"))
    return SS.test_coverage(sources, files)


PATH_SEARCH_K = 5
# Fixed search strings added to the data-derived ones (language codes).
EXTRA_QUERIES = ["", "main", "p1", "readme.md", "MOD", "/p10/"]


@register("path_search", f"""
WITH f AS (SELECT DISTINCT '@' || path AS option FROM v_files
           WHERE NOT list_has_any(string_split(substr(path, length(repo) + 2), '/')[1:-2],
                                  {'[' + sql_list(C.MENTION_IGNORE_DIRS)[1:-1] + ']'})
             AND NOT (CASE WHEN contains(ltrim(string_split(path, '/')[-1], '.'), '.')
                           THEN regexp_extract(string_split(path, '/')[-1], '^.+?(\\.[^.]*)$', 1) ELSE '' END)
                     IN {sql_list(C.MENTION_IGNORE_EXTENSIONS)}),
q AS (SELECT DISTINCT lower(lang) AS query FROM documents
      UNION SELECT lower(unnest({'[' + sql_list(EXTRA_QUERIES)[1:-1] + ']'})))
SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY len(string_split(option, '/')),
                                       lower(substr(option, 2)), option) AS INTEGER) AS rank, option
FROM q JOIN f ON contains(lower(substr(f.option, 2)), q.query)
QUALIFY rank <= {PATH_SEARCH_K}""")
def q_path_search(spark, sf_dir):
    t = Tables(spark, sf_dir)
    files = C.corpus_scan_pruned(V.v_files(t), "mention_index")
    q = (t.documents.select(F.col("lang").alias("query")).distinct()
         .unionAll(spark.createDataFrame([(x,) for x in EXTRA_QUERIES], "query string")))
    return SS.path_search(files, q, PATH_SEARCH_K)


# Deterministic docstring generator: the first 8 words of the text.
DOC_WORDS = 8


@register("fill_missing", f"""
SELECT d.doc_id,
  CASE WHEN l.doc_id IS NOT NULL THEN 'q' || CAST(l.quality AS VARCHAR) || ' t' || CAST(l.toxic AS VARCHAR)
       ELSE replace(replace(array_to_string(list_filter(string_split_regex(d.text, '\\s+'), lambda x: x <> '')[1:{DOC_WORDS}], ' '),
                            '\"\"\"', ''), '''', '') END AS docstring,
  CASE WHEN l.doc_id IS NOT NULL THEN 'kept' ELSE 'generated' END AS action
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def q_fill_missing(spark, sf_dir):
    t = Tables(spark, sf_dir)
    existing = t.labels.select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string"), F.lit(" t"),
                                                   F.col("toxic").cast("string")).alias("docstring"))
    words = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    gen = F.array_join(F.slice(words, 1, DOC_WORDS), " ")
    return SS.fill_missing(t.documents.select("doc_id", "text"), existing, gen)
