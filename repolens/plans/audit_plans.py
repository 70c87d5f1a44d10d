"""Registered dependency-audit queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, extract
from ..sources import views as V
from ..sources.tables import Tables
from .registry import register
from .sqlparts import SELF_SQL, STDLIB_CLASSIFY_SQL, STDLIB_SQL, TOOL_ONLY_SQL, license_sql, norm_sql

# --- shared oracle CTEs ----------------------------------------------------

_RESOLVED = {
    "o_res": """
SELECT r.ref, coalesce(a.install_name, r.ref) AS install_name
FROM (SELECT DISTINCT ref FROM v_refs) r
LEFT JOIN (SELECT alias, min(install_name) AS install_name FROM v_alias GROUP BY alias) a ON a.alias = r.ref""",
    "o_dim": f"""
SELECT {norm_sql('name')} AS norm, name AS dist_name, version,
       {license_sql('license', 'classifiers_txt', 'name')} AS license
FROM (SELECT *, row_number() OVER (PARTITION BY {norm_sql('name')} ORDER BY name) AS rn FROM v_ref_dists) d
WHERE rn = 1""",
    "o_pkg": f"""
SELECT r.ref, r.install_name, d.dist_name IS NOT NULL AS installed, d.version, d.license
FROM o_res r LEFT JOIN o_dim d ON d.norm = {norm_sql('r.install_name')}""",
    "o_ext": """
SELECT ref, CASE WHEN installed THEN version ELSE 'Internal/Unknown' END AS version,
       CASE WHEN installed THEN license ELSE 'N/A' END AS license
FROM o_pkg WHERE installed OR ref NOT IN (SELECT name FROM v_ref_std)""",
    "o_index": """
SELECT ref, path, count(*) OVER (PARTITION BY ref) AS n_files
FROM (SELECT DISTINCT ref, path FROM v_refs WHERE ref IN (SELECT ref FROM o_ext)) x""",
}


def _page_audit(t: Tables):
    # The link extraction (regex over every page) feeds the reference table
    # and the dimension views derived from it: run it once, reliably.
    refs = extract.extract_links(t.pages).checkpoint(eager=True)
    external = audit.classify_refs(refs, V.v_ref_dists(t, refs), stdlib=V.v_ref_std(t, refs),
                                   aliases=V.v_alias(t, refs))
    return refs, external


@register("extract_links", "SELECT path, ref FROM v_refs")
def q_extract_links(spark, sf_dir):
    return extract.extract_links(Tables(spark, sf_dir).pages)


@register("resolve_packages", "SELECT ref, install_name, installed, version, license FROM o_pkg", _RESOLVED)
def q_resolve_packages(spark, sf_dir):
    t = Tables(spark, sf_dir)
    refs = extract.extract_links(t.pages).checkpoint(eager=True)
    return audit.resolve_packages(refs, V.v_ref_dists(t, refs), aliases=V.v_alias(t, refs))


@register("classify_refs", "SELECT ref, version, license FROM o_ext", _RESOLVED)
def q_classify_refs(spark, sf_dir):
    return _page_audit(Tables(spark, sf_dir))[1]


@register("ref_index", "SELECT ref, path, n_files FROM o_index", _RESOLVED)
def q_ref_index(spark, sf_dir):
    refs, external = _page_audit(Tables(spark, sf_dir))
    return audit.ref_index(refs, external)


@register("ranked_listing", """
SELECT i.ref AS library, coalesce(e.version, 'Unknown') AS version, coalesce(e.license, 'Unknown') AS license,
       i.path, i.n_files
FROM o_index i LEFT JOIN o_ext e ON e.ref = i.ref""", _RESOLVED)
def q_ranked_listing(spark, sf_dir):
    refs, external = _page_audit(Tables(spark, sf_dir))
    return audit.ranked_listing(audit.ref_index(refs, external), external)


@register("installed_edges", f"""
SELECT DISTINCT r.p_partkey AS pkg, {norm_sql("regexp_extract(r.requirement, '^([a-zA-Z0-9._-]+)', 1)")} AS dep
FROM v_requires r
WHERE regexp_extract(r.requirement, '^([a-zA-Z0-9._-]+)', 1) <> ''
  AND {norm_sql("regexp_extract(r.requirement, '^([a-zA-Z0-9._-]+)', 1)")} IN (SELECT {norm_sql('name')} FROM v_dists)""")
def q_installed_edges(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return audit.installed_edges(V.v_requires(t), V.v_dists(t))


# --- source-code audit: v_code files per repository, v_manifests ------------

_CODE = {
    "o_code_refs": """
SELECT DISTINCT p_partkey AS repo, path, ref FROM (
  SELECT p_partkey, path, 'os' AS ref FROM v_code
  UNION ALL SELECT p_partkey, path, split_part(replace(p_name, ' ', '_'), '.', 1) FROM v_code JOIN part USING (p_partkey)
  UNION ALL SELECT p_partkey, path, split_part(lower(p_type), '.', 1) FROM v_code JOIN part USING (p_partkey)) x""",
    "o_declared": f"""
SELECT DISTINCT repo, {norm_sql('n')} AS name FROM (
  SELECT repo, regexp_extract(item, '^([a-zA-Z0-9._-]+)', 1) AS n FROM (
    SELECT repo_id AS repo, unnest(
      CASE WHEN regexp_matches(manifest, '(?s)dependencies = \\[(.*?)\\]')
           THEN regexp_extract_all(regexp_extract(manifest, '(?s)dependencies = \\[(.*?)\\]', 1), '"([^"]+)"', 1)
                || regexp_extract_all(regexp_extract(manifest, '(?s)dependencies = \\[(.*?)\\]', 1), '''([^'']+)''', 1)
           ELSE [] END
      || CASE WHEN regexp_matches(manifest, '(?s)dev = \\[(.*?)\\]')
           THEN regexp_extract_all(regexp_extract(manifest, '(?s)dev = \\[(.*?)\\]', 1), '"([^"]+)"', 1)
           ELSE [] END) AS item
    FROM v_manifests) i) j
WHERE n <> ''""",
    "o_code_ext": f"""
SELECT DISTINCT ref FROM o_code_refs
WHERE {norm_sql('ref')} IN (SELECT {norm_sql('name')} FROM v_dists) OR ref NOT IN {STDLIB_CLASSIFY_SQL}""",
    "o_used": f"""
SELECT DISTINCT r.repo, {norm_sql('r.ref')} AS name FROM o_code_refs r WHERE r.ref IN (SELECT ref FROM o_code_ext)""",
    "o_report": f"""
SELECT d.repo, 'unused' AS kind, d.name FROM o_declared d
WHERE NOT EXISTS (SELECT 1 FROM o_used u WHERE u.repo = d.repo AND u.name = d.name) AND d.name NOT IN {TOOL_ONLY_SQL}
UNION ALL
SELECT u.repo, 'undeclared' AS kind, u.name FROM o_used u
WHERE u.repo IN (SELECT repo_id FROM v_manifests)
  AND NOT EXISTS (SELECT 1 FROM o_declared d WHERE d.repo = u.repo AND d.name = u.name)
  AND u.name NOT IN {STDLIB_SQL} AND u.name NOT IN {SELF_SQL}""",
}


def _code_audit(t: Tables):
    code = V.v_code(t).withColumn("repo", F.col("p_partkey"))
    # The Python extraction feeds two branches (classification of distinct
    # names, and the used names per repo): materialise it once, reliably.
    refs = extract.extract_refs(code, keys=["repo", "path"]).checkpoint(eager=True)
    external = audit.classify_refs(refs, V.v_dists(t))
    used = audit.used_install_names(refs.join(external.select("ref"), "ref", "left_semi"))
    man = V.v_manifests(t)
    declared = extract.extract_declared(man)
    report = audit.integrity_check(declared, used, repos=man.select(F.col("repo_id").alias("repo")),
                                   project_names=extract.extract_project_name(man))
    return code, refs, external, report


@register("extract_refs", "SELECT path, ref FROM o_code_refs", _CODE)
def q_extract_refs(spark, sf_dir):
    return extract.extract_refs(V.v_code(Tables(spark, sf_dir)))


@register("extract_declared", "SELECT repo, name FROM o_declared", _CODE)
def q_extract_declared(spark, sf_dir):
    return extract.extract_declared(V.v_manifests(Tables(spark, sf_dir)))


@register("integrity_check", "SELECT repo, kind, name FROM o_report", _CODE)
def q_integrity_check(spark, sf_dir):
    return _code_audit(Tables(spark, sf_dir))[3]


@register("integrity_gate", """
SELECT repo, count(*) FILTER (WHERE kind = 'unused') AS n_unused,
       count(*) FILTER (WHERE kind = 'undeclared') AS n_undeclared, count(*) > 0 AS failed
FROM o_report GROUP BY repo""", _CODE)
def q_integrity_gate(spark, sf_dir):
    return audit.integrity_counts(_code_audit(Tables(spark, sf_dir))[3])


@register("audit_summary", """
SELECT m.repo, m.n_files, coalesce(r.n_refs, 0) AS n_refs, coalesce(e.n_external, 0) AS n_external,
       coalesce(g.n_unused, 0) AS n_unused, coalesce(g.n_undeclared, 0) AS n_undeclared
FROM (SELECT p_partkey AS repo, count(*) AS n_files FROM v_code GROUP BY 1) m
LEFT JOIN (SELECT repo, count(DISTINCT ref) AS n_refs FROM o_code_refs GROUP BY 1) r USING (repo)
LEFT JOIN (SELECT repo, count(DISTINCT ref) AS n_external FROM o_code_refs WHERE ref IN (SELECT ref FROM o_code_ext)
           GROUP BY 1) e USING (repo)
LEFT JOIN (SELECT repo, count(*) FILTER (WHERE kind = 'unused') AS n_unused,
                  count(*) FILTER (WHERE kind = 'undeclared') AS n_undeclared FROM o_report GROUP BY 1) g USING (repo)""",
          _CODE)
def q_audit_summary(spark, sf_dir):
    code, refs, external, report = _code_audit(Tables(spark, sf_dir))
    return audit.audit_summary(code, refs, external, report)
