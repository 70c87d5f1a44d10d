"""Registered queries: corpus scans and scalar text/name functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import text as X
from ..operators import settings as S
from ..session import scratch_folder
from ..sources import corpus as C
from ..sources import views as V
from ..sources.files import write_files
from ..sources.tables import Tables
from .registry import register
from .sqlparts import license_sql, norm_sql, sql_list

_NAME = "string_split(path, '/')[-1]"
_REL = "substr(path, length(repo) + 2)"


@register("corpus_scan", f"""
SELECT doc_id, repo, path FROM v_files
WHERE NOT ({_NAME} LIKE '%.pycache' OR {_NAME} LIKE '%.pyc' OR {_NAME} LIKE '%.pyo') AND {_NAME} <> '__init__.py'""")
def q_corpus_scan(spark, sf_dir):
    return C.corpus_scan(V.v_files(Tables(spark, sf_dir))).select("doc_id", "repo", "path")


@register("corpus_files", f"SELECT repo, {_REL} AS path, content, CAST(NULL AS VARCHAR) AS error FROM v_files")
def q_corpus_files(spark, sf_dir):
    """S1/S2 from a file tree: every row of v_files written out as a file
    (``__init__.py`` and ``.git`` among them) and read back."""
    root = scratch_folder(spark, "files/corpus")
    write_files(V.v_files(Tables(spark, sf_dir)), root)
    return C.read_corpus(spark, root)


@register("corpus_files_pruned", f"""
SELECT repo, {_REL} AS path, content FROM v_files
WHERE {_NAME} LIKE '%.py' AND NOT list_has_any(string_split(path, '/'), ['.git', 'venv'])""")
def q_corpus_files_pruned(spark, sf_dir):
    """S2 with the name filter and the ignored directories pushed into the listing."""
    root = scratch_folder(spark, "files/pruned")
    write_files(V.v_files(Tables(spark, sf_dir)), root)
    return C.read_corpus(spark, root, glob="*.py", skip_dirs=[".git", "venv"]).select("repo", "path", "content")


def _no_dirs(ignore) -> str:
    return (f"NOT list_has_any(string_split({_REL}, '/')[1:len(string_split({_REL}, '/')) - 1], "
            f"[{', '.join(repr(d) for d in ignore)}])")


@register("corpus_scan_pruned", f"""
SELECT doc_id, repo, path, {_REL} AS rel_path FROM v_files
WHERE {_no_dirs(C.AUDIT_IGNORE_DIRS)} AND {_NAME} LIKE '%.py'
  AND NOT ({_NAME} LIKE '%.pycache' OR {_NAME} LIKE '%.pyc' OR {_NAME} LIKE '%.pyo') AND {_NAME} <> '__init__.py'""")
def q_corpus_scan_pruned(spark, sf_dir):
    return C.corpus_scan_pruned(V.v_files(Tables(spark, sf_dir)), "audit").select("doc_id", "repo", "path", "rel_path")


@register("find_python_files", f"""
SELECT doc_id, repo, {_REL} AS rel_path FROM v_files
WHERE {_no_dirs(C.SOURCE_FINDER_IGNORE_DIRS)}
  AND NOT list_bool_or(list_transform(string_split({_REL}, '/')[1:len(string_split({_REL}, '/')) - 1],
                                      lambda d: contains(d, '.env')))
  AND {_NAME} LIKE '%.py' AND NOT contains({_NAME}, '.env')""")
def q_find_python_files(spark, sf_dir):
    return C.corpus_scan_pruned(V.v_files(Tables(spark, sf_dir)), "source_finder").select("doc_id", "repo", "rel_path")


@register("dir_listing", """
SELECT DISTINCT array_to_string(parts[1:i], '/') AS directory, parts[i + 1] AS child
FROM (SELECT string_split(path, '/') AS parts FROM v_files) f,
     LATERAL (SELECT unnest(range(1, len(parts))) AS i) r
WHERE NOT contains(parts[i + 1], '.env')""")
def q_dir_listing(spark, sf_dir):
    return C.dir_listing(V.v_files(Tables(spark, sf_dir)))


@register("project_structure", f"""
WITH f AS (SELECT repo, {_REL} AS rel, string_split({_REL}, '/') AS parts FROM v_files)
SELECT DISTINCT repo, 'directory' AS kind, array_to_string(parts[1:i], '/') AS path
FROM f, LATERAL (SELECT unnest(range(1, len(parts))) AS i) r
WHERE NOT list_has_any(parts[1:i], [{', '.join(repr(d) for d in C.OVERVIEW_IGNORE_DIRS)}])
UNION
SELECT DISTINCT repo, 'python_file', rel FROM f
WHERE rel LIKE '%.py' AND NOT list_has_any(parts[1:-2], [{', '.join(repr(d) for d in C.OVERVIEW_IGNORE_DIRS)}])""")
def q_project_structure(spark, sf_dir):
    return C.project_structure(V.v_files(Tables(spark, sf_dir)))


@register("read_documents", f"""
WITH req AS (SELECT path FROM v_files UNION ALL SELECT path || '.bak' FROM v_files)
SELECT r.path,
       CASE WHEN contains(r.path, '.env') THEN '{C.UNSAFE_READ_ERROR}'
            WHEN f.path IS NULL THEN 'Error reading file: [Errno 2] No such file or directory: ''' || r.path || ''''
            ELSE f.content END AS content,
       NOT contains(r.path, '.env') AND f.path IS NOT NULL AS ok
FROM req r LEFT JOIN v_files f ON f.path = r.path""")
def q_read_documents(spark, sf_dir):
    files = V.v_files(Tables(spark, sf_dir))
    req = files.select("path").unionAll(files.select(F.concat("path", F.lit(".bak")).alias("path")))
    return C.read_documents(req, files)


@register("safe_path_filter", "SELECT doc_id, path FROM v_files WHERE NOT contains(path, '.env')")
def q_safe_path_filter(spark, sf_dir):
    return V.v_files(Tables(spark, sf_dir)).where(X.is_safe_path("path")).select("doc_id", "path")


# Override word list for the command audit on prose (the default words do not
# occur in the documents).
AUDIT_WORDS = ["the", "and", "mit"]


@register("command_audit", f"""
SELECT doc_id, NOT regexp_matches(lower(text),
  '(^|[^\\p{{L}}\\p{{N}}_])({"|".join(AUDIT_WORDS)})($|[^\\p{{L}}\\p{{N}}_])') AS safe
FROM documents""")
def q_command_audit(spark, sf_dir):
    d = Tables(spark, sf_dir).documents
    return d.select("doc_id", X.is_safe_command("text", AUDIT_WORDS).alias("safe"))


@register("normalize_name", """
SELECT p_partkey, pos, lower(replace(split_part(requirement, '[', 1), '_', '-')) AS name FROM v_requires""")
def q_normalize_name(spark, sf_dir):
    r = V.v_requires(Tables(spark, sf_dir))
    return r.select("p_partkey", "pos", N.normalize_name("requirement").alias("name"))


@register("parse_requirement", f"""
SELECT p_partkey, pos, {norm_sql("regexp_extract(requirement, '^([a-zA-Z0-9._-]+)', 1)")} AS name
FROM v_requires WHERE regexp_extract(requirement, '^([a-zA-Z0-9._-]+)', 1) <> ''""")
def q_parse_requirement(spark, sf_dir):
    r = V.v_requires(Tables(spark, sf_dir))
    n = N.requirement_name("requirement")
    return r.where(n.isNotNull()).select("p_partkey", "pos", N.normalize_name(n, strip_extras=False).alias("name"))


@register("license_resolution", f"""
SELECT p_partkey, name, {license_sql('license', 'classifiers_txt', 'name')} AS license FROM v_dists""")
def q_license_resolution(spark, sf_dir):
    d = V.v_dists(Tables(spark, sf_dir))
    cls = F.split("classifiers_txt", r"\|")
    return d.select("p_partkey", "name", N.resolve_license("license", cls, "name").alias("license"))


@register("truncate_text", f"""
SELECT doc_id, CASE WHEN length(text) > {X.MAX_DIFF_CHARS}
                    THEN substr(text, 1, {X.MAX_DIFF_CHARS}) || chr(10) || '... (truncated for brevity)'
                    ELSE text END AS text
FROM documents""")
def q_truncate_text(spark, sf_dir):
    d = Tables(spark, sf_dir).documents
    return d.select("doc_id", X.truncate_text("text").alias("text"))


def _duck_ws() -> str:
    return "'" + "".join(X.PY_WHITESPACE).replace("'", "''") + "'"


_FENCED = "CASE WHEN turn % 2 = 0 THEN '```text' || chr(10) || text || chr(10) || '```' ELSE text END"


@register("clean_fenced_text", f"""
WITH c AS (SELECT conv_id, turn, {_FENCED} AS raw FROM conversations),
s AS (SELECT conv_id, turn, raw, trim(raw, {_duck_ws()}) AS st FROM c),
l AS (SELECT *, string_split_regex(st, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]') AS lines FROM s)
SELECT conv_id, turn,
  CASE WHEN raw IS NULL OR raw = '' THEN raw
       WHEN starts_with(st, '```') AND ends_with(st, '```')
         THEN trim(array_to_string(CASE WHEN len(lines) > 2 THEN lines[2:len(lines) - 1] ELSE [] END, chr(10)),
                   {_duck_ws()})
       ELSE st END AS text
FROM l""")
def q_clean_fenced_text(spark, sf_dir):
    c = Tables(spark, sf_dir).conversations
    raw = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("```text\n"), F.col("text"), F.lit("\n```"))) \
        .otherwise(F.col("text"))
    return c.select("conv_id", "turn", X.clean_fenced_text(raw).alias("text"))


@register("sanitize_docstring", """
SELECT doc_id, replace(replace(text, '\"\"\"', ''), '''', '') AS text FROM documents""")
def q_sanitize_docstring(spark, sf_dir):
    d = Tables(spark, sf_dir).documents
    return d.select("doc_id", X.sanitize_docstring("text").alias("text"))


@register("history_preview", """
SELECT conv_id, turn,
  '[' || coalesce(role, 'unknown') || ']: ' ||
  CASE WHEN coalesce(text, '') <> '' THEN substr(text, 1, 50) || '...' ELSE '' END AS preview
FROM conversations""")
def q_history_preview(spark, sf_dir):
    from ..operators.sessions import history

    return history(Tables(spark, sf_dir).conversations)


@register("extract_mentions", """
SELECT doc_id, unnest(regexp_extract_all(text, '@([\\p{L}\\p{N}_./-]+)', 1)) AS mention FROM documents""")
def q_extract_mentions(spark, sf_dir):
    d = Tables(spark, sf_dir).documents
    return d.select("doc_id", F.explode(X.extract_mentions("text")).alias("mention"))


# Literal values added to the typed-value input to cover the parser's cases.
TYPED_LITERALS = ["TRUE", "false", "1.50", "1.5d", "abc", " 42 ", "1_000", "-3.", ".5e1", "2f", "1.2.3", "+7", ""]


@register("coerce_typed_value", f"""
WITH v AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS value FROM orders
  UNION ALL SELECT o_orderpriority FROM orders
  UNION ALL SELECT CAST(o_totalprice AS VARCHAR) FROM orders
  UNION ALL SELECT unnest({'[' + ', '.join(sql_list([x])[1:-1] for x in TYPED_LITERALS) + ']'})),
k AS (
  SELECT value, trim(value, {_duck_ws()}) AS s,
    lower(value) IN ('true', 'false') AS is_bool,
    lower(value) NOT IN ('true', 'false') AND contains(value, '.')
      AND regexp_matches(trim(value, {_duck_ws()}),
        '^[+-]?(([0-9](_?[0-9])*)?\\.[0-9](_?[0-9])*|[0-9](_?[0-9])*\\.)([eE][+-]?[0-9](_?[0-9])*)?$') AS is_float,
    lower(value) NOT IN ('true', 'false') AND NOT contains(value, '.')
      AND regexp_matches(trim(value, {_duck_ws()}), '^[+-]?[0-9](_?[0-9])*$') AS is_int
  FROM v)
SELECT value,
  CASE WHEN is_bool THEN 'bool' WHEN is_float THEN 'float' WHEN is_int THEN 'int' ELSE 'string' END AS type,
  CASE WHEN is_bool THEN lower(value) = 'true' END AS bool_value,
  CASE WHEN is_int THEN TRY_CAST(replace(s, '_', '') AS BIGINT) END AS int_value,
  CASE WHEN is_float THEN TRY_CAST(replace(s, '_', '') AS DOUBLE) END AS float_value,
  CASE WHEN NOT is_bool AND NOT is_float AND NOT is_int THEN value END AS str_value
FROM k""")
def q_coerce_typed_value(spark, sf_dir):
    o = Tables(spark, sf_dir).orders
    lit = spark.createDataFrame([(x,) for x in TYPED_LITERALS], "value string")
    v = (o.select(F.col("o_orderkey").cast("string").alias("value"))
         .unionAll(o.select(F.col("o_orderpriority").alias("value")))
         .unionAll(o.select(F.col("o_totalprice").cast("string").alias("value")))
         .unionAll(lit))
    cols = S.coerce_typed_value("value")
    return v.select("value", *[c.alias(n) for n, c in cols.items()])


@register("assemble_context", """
WITH req AS (SELECT conv_id * 100 + turn AS request_id, conv_id, text AS request FROM conversations WHERE role = 'user'),
cf AS (SELECT r.request_id, 0 AS pos, f.path FROM req r JOIN v_files f ON f.doc_id = r.conv_id
       UNION ALL SELECT request_id, 1, 'missing/' || CAST(conv_id AS VARCHAR) || '.py' FROM req),
b AS (SELECT cf.request_id, string_agg(chr(10) || '--- ' || cf.path || ' ---' || chr(10)
             || coalesce(f.content, 'Error reading: [Errno 2] No such file or directory: ''' || cf.path || '''')
             || chr(10), '' ORDER BY cf.pos) AS ctx
      FROM cf LEFT JOIN v_files f ON f.path = cf.path GROUP BY cf.request_id)
SELECT r.request_id, CASE WHEN b.ctx IS NOT NULL THEN r.request || chr(10) || chr(10) || 'Context files:' || chr(10) || b.ctx
                          ELSE r.request END AS request
FROM req r LEFT JOIN b USING (request_id)""")
def q_assemble_context(spark, sf_dir):
    t = Tables(spark, sf_dir)
    files = V.v_files(t)
    req = (t.conversations.where(F.col("role") == "user")
           .select((F.col("conv_id") * 100 + F.col("turn")).alias("request_id"), "conv_id",
                   F.col("text").alias("request")))
    cf = (req.join(files.select(F.col("doc_id").alias("conv_id"), "path"), "conv_id")
          .select("request_id", F.lit(0).alias("pos"), "path")
          .unionByName(req.select("request_id", F.lit(1).alias("pos"),
                                  F.concat(F.lit("missing/"), F.col("conv_id").cast("string"), F.lit(".py")).alias("path"))))
    return C.assemble_context(req, cf, files)


@register("name_index", f"""
WITH f AS (SELECT DISTINCT path, string_split(path, '/')[-1] AS name FROM v_files
           WHERE NOT list_has_any(string_split(substr(path, length(repo) + 2), '/')[1:-2],
                                  {'[' + sql_list(C.MENTION_IGNORE_DIRS)[1:-1] + ']'})
             AND NOT (CASE WHEN contains(ltrim(string_split(path, '/')[-1], '.'), '.')
                           THEN regexp_extract(string_split(path, '/')[-1], '^.+?(\\.[^.]*)$', 1) ELSE '' END)
                     IN {sql_list(C.MENTION_IGNORE_EXTENSIONS)})
SELECT name AS ref, path, count(*) OVER (PARTITION BY name) AS n_files FROM f""")
def q_name_index(spark, sf_dir):
    """A1, file-name shape: file name -> paths of the mention index (long form)."""
    from ..operators.audit import ref_index

    files = C.corpus_scan_pruned(V.v_files(Tables(spark, sf_dir)), "mention_index")
    named = files.select("path", C.file_name("path").alias("ref"))
    return ref_index(named, named.select("ref"))
