"""Registered queries: source-structure extraction over ``v_code`` and the
JSON export sink."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, extract
from ..session import scratch_folder
from ..sources import sinks
from ..sources import views as V
from ..sources.tables import Tables
from .audit_plans import _RESOLVED, _page_audit
from .registry import register

_NAME = "replace(p_name, ' ', '_')"


@register("extract_structure", f"""
SELECT path, pos, kind, name, members, lineno FROM (
  SELECT path, 0 AS pos, 'import' AS kind, 'os' AS name, NULL AS members, 1 AS lineno FROM v_code
  UNION ALL SELECT c.path, 1, 'import', {_NAME} || '.sub', NULL, 1 FROM v_code c JOIN part USING (p_partkey)
  UNION ALL SELECT c.path, 2, 'import', lower(p_type) || '.core.x', NULL, 2 FROM v_code c JOIN part USING (p_partkey)
  UNION ALL SELECT path, 3, 'import', '.rel', NULL, 3 FROM v_code
  UNION ALL SELECT path, 4, 'class', 'C' || CAST(p_partkey AS VARCHAR), 'm1', 4 FROM v_code
  UNION ALL SELECT path, 5, 'function', 'f' || CAST(p_partkey % 50 AS VARCHAR), 'x,y',
                   CASE WHEN p_partkey % 2 = 0 THEN 10 ELSE 9 END FROM v_code) s""")
def q_extract_structure(spark, sf_dir):
    s = extract.extract_structure(V.v_code(Tables(spark, sf_dir)))
    return s.select("path", "pos", "kind", "name", F.array_join("members", ",").alias("members"), "lineno")


@register("find_function", """
WITH req AS (
  SELECT path, p_partkey, unnest(['m1', 'f' || CAST(p_partkey % 50 AS VARCHAR), 'm2', 'nope']) AS function_name
  FROM v_code
  UNION ALL SELECT '.env/' || path, p_partkey, 'm1' FROM v_code
  UNION ALL SELECT 'gone/' || path, p_partkey, 'm1' FROM v_code),
code AS (
SELECT path, function_name,
       CASE WHEN path LIKE '.env/%' OR path LIKE 'gone/%' OR p_partkey % 10 = 7 THEN NULL
            WHEN function_name = 'm1' THEN 'def m1(self, a):' || chr(10)
              || CASE WHEN p_partkey % 2 = 0 THEN '    ' || repeat('"', 3) || 'doc' || repeat('"', 3) || chr(10) ELSE '' END || '    return a'
            WHEN function_name = 'f' || CAST(p_partkey % 50 AS VARCHAR) THEN 'def ' || function_name || '(x, y):' || chr(10)
              || CASE WHEN p_partkey % 3 = 0 THEN '    ' || repeat('"', 3) || 'Doc.' || repeat('"', 3) || chr(10) ELSE '' END || '    return x' END AS code,
       CASE WHEN path LIKE '.env/%' THEN 'Error: Access to .env files is strictly prohibited.'
            WHEN path LIKE 'gone/%' THEN 'Error extracting function: [Errno 2] No such file or directory: ' || chr(39) || path || chr(39)
            WHEN p_partkey % 10 = 7 THEN 'Error extracting function: invalid syntax (<unknown>, line 1)'
            ELSE 'Function ' || chr(39) || function_name || chr(39) || ' not found in ' || path END AS error
FROM req)
SELECT path, function_name, code IS NOT NULL AS found, coalesce(code, error) AS code FROM code""")
def q_find_function(spark, sf_dir):
    """Whole code texts; every tenth file can't be parsed, and some requests
    name an unsafe or a missing path."""
    code = V.v_code(Tables(spark, sf_dir))
    names = F.array(F.lit("m1"), F.concat(F.lit("f"), (F.col("p_partkey") % 50).cast("string")), F.lit("m2"), F.lit("nope"))
    req = code.select("path", F.explode(names).alias("function_name"))
    for folder in (".env/", "gone/"):
        req = req.unionByName(code.select(F.concat(F.lit(folder), "path").alias("path"), F.lit("m1").alias("function_name")))
    files = code.withColumn("content", F.when(F.col("p_partkey") % 10 == 7, F.lit("def broken(:\n")).otherwise(F.col("content")))
    return extract.find_function(files, req)


@register("docstring_coverage", """
SELECT path, CAST(3 AS BIGINT) AS n_functions,
       CAST(1 + CASE WHEN p_partkey % 2 = 1 THEN 1 ELSE 0 END + CASE WHEN p_partkey % 3 <> 0 THEN 1 ELSE 0 END AS BIGINT)
         AS n_missing,
       (1 + CASE WHEN p_partkey % 2 = 1 THEN 1 ELSE 0 END + CASE WHEN p_partkey % 3 <> 0 THEN 1 ELSE 0 END) / 3.0
         AS missing_ratio
FROM v_code""")
def q_docstring_coverage(spark, sf_dir):
    return extract.docstring_coverage(V.v_code(Tables(spark, sf_dir)))


@register("json_export", """
SELECT i.ref AS library, coalesce(e.version, 'Unknown') AS version, coalesce(e.license, 'Unknown') AS license,
       i.path, i.n_files
FROM o_index i LEFT JOIN o_ext e ON e.ref = i.ref""", _RESOLVED)
def q_json_export(spark, sf_dir):
    """Writes the SBOM listing as JSON lines under the shared checkpoint
    folder and reads it back (the check compares parsed columns)."""
    refs, external = _page_audit(Tables(spark, sf_dir))
    listing = audit.ranked_listing(audit.ref_index(refs, external), external)
    out = scratch_folder(spark, "exports/sbom")
    sinks.write_json_lines(listing, out)
    return sinks.read_json_lines(spark, out, listing.schema)
