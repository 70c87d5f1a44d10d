"""DuckDB definitions of the derived views in ``repolens.sources.views``.

Oracle SQL strings are self-contained: ``with_views(sql)`` prepends, as CTEs,
every view the statement mentions (and the views those depend on), so the
driver only needs the base tables registered.
"""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {}
DEPS: dict[str, tuple[str, ...]] = {}


def _view(name: str, sql: str, deps: tuple[str, ...] = ()) -> None:
    VIEWS[name] = sql.strip()
    DEPS[name] = deps


_view("v_files", """
SELECT doc_id, source AS repo,
       source || '/' || CASE doc_id % 7 WHEN 0 THEN 'venv' WHEN 1 THEN 'lib' WHEN 2 THEN '.git' ELSE lang END
       || '/p' || CAST(doc_id AS VARCHAR) || '/'
       || CASE doc_id % 5 WHEN 0 THEN '__init__.py' WHEN 1 THEN 'mod.pyc' WHEN 2 THEN 'secret.env.py'
                          WHEN 3 THEN 'main.py' ELSE 'README.md' END AS path,
       text AS content
FROM documents""")

_view("v_repo_files", """
SELECT doc_id,
       CASE WHEN doc_id % 3 = 0 THEN 'pkg/m' || CAST(doc_id AS VARCHAR) || '.py'
            WHEN doc_id % 3 = 1 AND doc_id % 9 <> 1 THEN
              CASE doc_id % 4 WHEN 0 THEN 'pkg/test_m' WHEN 1 THEN 'pkg/tests/test_m'
                              WHEN 2 THEN 'tests/pkg/test_m' ELSE 'tests/test_m' END
              || CAST(doc_id - 1 AS VARCHAR) || '.py'
            ELSE 'docs/n' || CAST(doc_id AS VARCHAR) || '.md' END AS path
FROM documents""")

_view("v_refs", """
SELECT DISTINCT path, ref FROM (
  SELECT url AS path, regexp_extract(unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)), '^/?([^/?#]+)', 1) AS ref
  FROM pages)
WHERE ref <> ''""")

_view("v_edges", """
SELECT DISTINCT src, dst FROM (
  SELECT p_partkey AS src, CAST((p_partkey - p_partkey % 2) / 2 AS BIGINT) AS dst FROM part WHERE p_partkey > 0
  UNION ALL
  SELECT p_partkey AS src, CAST(p_size AS BIGINT) AS dst FROM part) e
WHERE src <> dst""")

_view("v_tree_edges", """
SELECT DISTINCT src, dst FROM (
  SELECT p_partkey AS src, CAST(p_partkey // 2 AS BIGINT) AS dst FROM part WHERE p_partkey > 1
  UNION ALL
  SELECT p_partkey, CAST(p_partkey // 4 AS BIGINT) FROM part WHERE p_partkey > 3 AND p_partkey % 3 = 0
  UNION ALL
  SELECT CAST(p_partkey // 2 AS BIGINT), p_partkey FROM part WHERE p_partkey > 40 AND p_partkey % 10 = 7) e
WHERE src <> dst AND dst > 0""")

_view("v_dists", """
SELECT p_partkey, replace(p_name, ' ', '_') || '_' || CAST(p_partkey AS VARCHAR) AS name,
       CAST(p_size AS VARCHAR) AS version,
       CASE p_partkey % 4 WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN NULL WHEN 2 THEN '' ELSE p_type END AS license,
       CASE WHEN p_partkey % 3 = 0 THEN 'Topic :: Tools|License :: OSI Approved :: ' || p_brand
            ELSE 'Topic :: Tools' END AS classifiers_txt
FROM part""")

_view("v_requires", """
SELECT a.p_partkey, 0 AS pos,
       replace(b.p_name, ' ', '_') || '_' || CAST(b.p_partkey AS VARCHAR) || '[extra]>=1.0' AS requirement
FROM part a JOIN part b ON b.p_partkey = CAST((a.p_partkey - a.p_partkey % 2) / 2 AS BIGINT)
UNION ALL
SELECT a.p_partkey, 1 AS pos, upper(replace(b.p_name, ' ', '-')) || '-' || CAST(b.p_partkey AS VARCHAR) || ' <2' AS requirement
FROM part a JOIN part b ON b.p_partkey = a.p_size
UNION ALL
SELECT p_partkey, 2 AS pos, '(invalid' AS requirement FROM part""")

_view("v_tree_requires", """
SELECT e.src AS p_partkey, e.dst AS pos, upper(d.name) || '>=1.0' AS requirement
FROM v_tree_edges e JOIN v_dists d ON d.p_partkey = e.dst""", ("v_tree_edges", "v_dists"))

_view("v_manifests", """
SELECT p_partkey AS repo_id,
       '[project]' || chr(10) || 'dependencies = [' || chr(10) || '    "' || replace(p_name, ' ', '_') || '>=1",' || chr(10)
       || '    ''' || p_type || ''',' || chr(10) || ']' || chr(10) || 'dev = ["' || replace(p_brand, '#', '-') || '"]' AS manifest
FROM part""")

_view("v_calls", """
SELECT event_id, user_id AS run, ts, value AS seconds, event_type,
       CASE event_type
         WHEN 'click' THEN '{"prompt_tokens":' || k || ',"completion_tokens":' || o || ',"details":{"cached":1}}'
         WHEN 'view' THEN '{"input_tokens":' || k || ',"output_tokens":' || o || '}'
         WHEN 'purchase' THEN '{"total_tokens":' || k || ',"completion_tokens":' || o || '}'
         WHEN 'signup' THEN '{"prompt_tokens":0,"input_tokens":' || k || ',"completion_tokens":0,"output_tokens":' || o || '}'
         ELSE NULL END AS usage_json
FROM (SELECT *, regexp_extract(props, '([0-9]+)', 1) AS k, CAST(event_id % 50 AS VARCHAR) AS o FROM events) e""")

_view("v_decisions", """
SELECT user_id AS session, event_id AS seq,
       CASE event_type WHEN 'purchase' THEN 'write_file' WHEN 'signup' THEN 'write_file' WHEN 'error' THEN 'run_command'
                       WHEN 'click' THEN 'read_file' ELSE 'list_files' END AS tool,
       CASE WHEN event_id % 60 = 7 THEN 'always' WHEN event_id % 60 = 11 THEN 'session'
            WHEN event_id % 3 = 0 THEN 'n' ELSE 'y' END AS choice
FROM events""")

_view("v_chunks", """
SELECT response_id, CAST((s + 39) / 40 AS BIGINT) AS seq, substr(text, s, 40) AS frag
FROM (SELECT conv_id * 100 + turn AS response_id, text, unnest(range(1, length(text) + 1, 40)) AS s
      FROM conversations WHERE role = 'assistant' AND length(text) > 0) c""")

_view("v_diffs", """
SELECT source AS change_set, doc_id AS pos, source || '/p' || CAST(doc_id AS VARCHAR) AS path, text AS diff
FROM documents""")

_view("v_layers", """
SELECT priority, key_path, max(o_orderkey) AS value FROM (
  SELECT CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority, o_orderkey,
         'c' || CAST(o_custkey AS VARCHAR)
         || CASE WHEN (o_custkey + CAST(substr(o_orderpriority, 1, 1) AS INT)) % 4 = 0 THEN ''
                 ELSE '.k' || CAST(o_orderkey % 5 AS VARCHAR) END AS key_path
  FROM orders) o
GROUP BY priority, key_path""")

_view("v_declared", """
SELECT DISTINCT ref AS name FROM v_refs WHERE length(ref) % 2 = 0
UNION SELECT name FROM v_dists WHERE p_partkey < 20""", ("v_refs", "v_dists"))

_view("v_alias", """
SELECT DISTINCT ref AS alias, lower(ref) AS install_name FROM v_refs WHERE ref <> lower(ref)""", ("v_refs",))

_view("v_ref_dists", """
SELECT DISTINCT lower(ref) AS name, CAST(length(ref) AS VARCHAR) || '.0' AS version,
       CASE WHEN length(ref) % 2 = 0 THEN 'MIT' ELSE NULL END AS license,
       CASE WHEN length(ref) % 4 = 3 THEN 'License :: OSI Approved :: BSD License' ELSE '' END AS classifiers_txt
FROM v_refs WHERE length(ref) % 3 = 0""", ("v_refs",))

_view("v_ref_std", """
SELECT DISTINCT lower(ref) AS name FROM v_refs WHERE length(ref) % 3 = 1""", ("v_refs",))

_view("v_registry", """
SELECT 'click' AS tool, 'k' AS param, TRUE AS required
UNION ALL SELECT 'view', 'k', FALSE
UNION ALL SELECT 'purchase', 'k', TRUE
UNION ALL SELECT 'purchase', 'amount', TRUE
UNION ALL SELECT 'error', 'code', FALSE""")

_view("v_code", '''
SELECT p_partkey, 'pkg/c' || CAST(p_partkey AS VARCHAR) || '.py' AS path,
       'import os, ' || replace(p_name, ' ', '_') || '.sub' || chr(10)
       || 'from ' || lower(p_type) || '.core import x' || chr(10)
       || 'from . import rel' || chr(10)
       || 'class C' || CAST(p_partkey AS VARCHAR) || ':' || chr(10)
       || '    def m1(self, a):' || chr(10)
       || CASE WHEN p_partkey % 2 = 0 THEN '        "doc"' || chr(10) ELSE '' END
       || '        return a' || chr(10)
       || '    async def m2(self):' || chr(10)
       || '        pass' || chr(10)
       || 'def f' || CAST(p_partkey % 50 AS VARCHAR) || '(x, y):' || chr(10)
       || CASE WHEN p_partkey % 3 = 0 THEN '    """Doc."""' || chr(10) ELSE '' END
       || '    return x' || chr(10) AS content
FROM part''')


def _needed(sql: str) -> list[str]:
    order: list[str] = []

    def visit(name: str) -> None:
        for d in DEPS[name]:
            visit(d)
        if name not in order:
            order.append(name)

    for name in VIEWS:
        if re.search(rf"\b{name}\b", sql):
            visit(name)
    return order


def with_views(sql: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``sql`` with CTEs for the views it uses.

    ``extra`` adds statement-specific CTEs (name -> body) after the views.
    """
    names = _needed(sql + " ".join((extra or {}).values()))
    ctes = [f"{n} AS (\n{VIEWS[n]}\n)" for n in names]
    ctes += [f"{n} AS (\n{body.strip()}\n)" for n, body in (extra or {}).items()]
    body = sql.strip()
    if not ctes:
        return body
    head = "WITH "
    m = re.match(r"(?is)^with\s+(recursive\s+)?", body)
    if m:
        # Merge with the statement's own CTE list (keeping RECURSIVE).
        if m.group(1):
            head = "WITH RECURSIVE "
        return head + ",\n".join(ctes) + ",\n" + body[m.end():]
    return head + ",\n".join(ctes) + "\n" + body
