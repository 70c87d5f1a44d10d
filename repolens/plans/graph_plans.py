"""Registered queries: dependency-graph operators over the part graph.

Installed packages are the parts; edges are ``v_edges`` restricted to
installed targets.  Roots are the packages nothing requires (in-degree 0),
i.e. the top of the graph, derived from the data.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, extract
from ..operators import graph as G
from ..operators import packages as P
from ..sources import views as V
from ..sources.tables import Tables
from .registry import register
from .sqlparts import norm_sql

_G = {
    "o_edges": "SELECT src, dst FROM v_edges WHERE dst IN (SELECT p_partkey FROM part)",
    "o_roots": "SELECT p_partkey AS node FROM part WHERE p_partkey NOT IN (SELECT dst FROM o_edges)",
}


def _graph(t: Tables):
    inst = t.part.select(F.col("p_partkey").alias("node"))
    edges = V.v_edges(t).join(G.by_key(inst.select(F.col("node").alias("dst"))), "dst", "left_semi")
    roots = inst.join(G.by_key(edges.select(F.col("dst").alias("node"))), "node", "left_anti")
    return edges, roots, inst


@register("reverse_deps", f"""
SELECT target, name AS package, version, requirement FROM (
  SELECT r.p_partkey, r.pos, r.requirement,
         {norm_sql("regexp_extract(r.requirement, '^([a-zA-Z0-9._-]+)', 1)")} AS target
  FROM v_requires r WHERE regexp_extract(r.requirement, '^([a-zA-Z0-9._-]+)', 1) <> '') x
JOIN v_dists d USING (p_partkey)
QUALIFY row_number() OVER (PARTITION BY x.p_partkey, target ORDER BY pos) = 1""")
def q_reverse_deps(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return G.reverse_deps(V.v_dists(t), V.v_requires(t))


@register("reachable", """
WITH RECURSIVE r(node) AS (
  SELECT node FROM o_roots
  UNION
  SELECT e.dst FROM r JOIN o_edges e ON e.src = r.node)
SELECT node FROM r""", _G)
def q_reachable(spark, sf_dir):
    edges, roots, inst = _graph(Tables(spark, sf_dir))
    return G.reachable(edges, roots, inst)


@register("reachable_reverse", """
WITH RECURSIVE r(node) AS (
  SELECT CAST(p_size AS BIGINT) AS node FROM part WHERE p_size IN (SELECT p_partkey FROM part)
  UNION
  SELECT e.src FROM r JOIN o_edges e ON e.dst = r.node)
SELECT node FROM r""", _G)
def q_reachable_reverse(spark, sf_dir):
    """Transitive dependents of every package used as a size target."""
    t = Tables(spark, sf_dir)
    edges, _, inst = _graph(t)
    targets = t.part.select(F.col("p_size").cast("bigint").alias("node"))
    return G.reachable(edges, targets, inst, direction="in")


@register("reachable_by_jumps", """
WITH RECURSIVE r(node) AS (
  SELECT node FROM o_roots
  UNION
  SELECT e.dst FROM r JOIN o_edges e ON e.src = r.node)
SELECT node FROM r""", _G)
def q_reachable_by_jumps(spark, sf_dir):
    """G2 by path doubling."""
    edges, roots, inst = _graph(Tables(spark, sf_dir))
    return G.reachable_by_jumps(edges, roots, inst)


# G1 walks every branch: its graph has few branches per root.
_TREE = {
    "o_tree": "SELECT src, dst FROM v_tree_edges WHERE dst IN (SELECT p_partkey FROM part)",
    "o_tree_roots": "SELECT p_partkey AS node FROM part WHERE p_partkey NOT IN (SELECT dst FROM o_tree)",
}


def _tree(t: Tables):
    inst = t.part.select(F.col("p_partkey").alias("node"))
    edges = V.v_tree_edges(t).join(G.by_key(inst.select(F.col("node").alias("dst"))), "dst", "left_semi")
    return edges, inst.join(G.by_key(edges.select(F.col("dst").alias("node"))), "node", "left_anti"), inst


@register("dep_tree", """
WITH RECURSIVE t(root, depth, parent, node, path, recursive) AS (
  SELECT node, 0, CAST(NULL AS BIGINT), node, [node], false FROM o_tree_roots
  UNION ALL
  SELECT t.root, t.depth + 1, t.node, e.dst, list_append(t.path, e.dst), list_contains(t.path, e.dst)
  FROM t JOIN o_tree e ON e.src = t.node
  WHERE NOT t.recursive)
SELECT root, depth, parent, node, array_to_string(path, '>') AS path, recursive FROM t""", _TREE)
def q_dep_tree(spark, sf_dir):
    """Every branch to its end."""
    edges, roots, inst = _tree(Tables(spark, sf_dir))
    return G.dep_tree(edges, roots, inst, sep=">")


@register("preorder_tree")
def q_preorder_tree(spark, sf_dir):
    """No SQL twin (lexicographically smallest simple paths); checked
    against a direct depth-first walk in the tests."""
    edges, roots, inst = _graph(Tables(spark, sf_dir))
    return G.preorder_tree(edges, roots, inst)


# The same operators on the names of installed packages: requirement edges
# (J3), roots from the imports of v_apps (U1, J2), names and versions at the end.
def _named(requires: str) -> dict[str, str]:
    req = norm_sql("regexp_extract(r.requirement, '^([a-zA-Z0-9._-]+)', 1)")
    return {
        "o_pkg": f"SELECT {norm_sql('name')} AS norm, min(name) AS name, arg_min(version, name) AS version FROM v_dists GROUP BY 1",
        "o_req": f"""SELECT DISTINCT {norm_sql('d.name')} AS src, p.norm AS dst, p.name AS dst_name
FROM {requires} r JOIN v_dists d USING (p_partkey) JOIN o_pkg p ON p.norm = {req}""",
        "o_app": f"SELECT {norm_sql('name')} AS norm, name FROM v_dists WHERE p_partkey % 20 = 0",
        "o_gone": "SELECT 'gone' || CAST(p_partkey AS VARCHAR) AS norm FROM part WHERE p_partkey % 40 = 0",
    }


_BRANCHES = """
WITH RECURSIVE t(root, depth, parent, node, path, names, recursive) AS (
  SELECT norm, 0, CAST(NULL AS VARCHAR), norm, [norm], name, false FROM o_app
  UNION ALL
  SELECT t.root, t.depth + 1, t.node, e.dst, list_append(t.path, e.dst), t.names || '>' || e.dst_name, list_contains(t.path, e.dst)
  FROM t JOIN o_req e ON e.src = t.node WHERE NOT t.recursive)"""


def _packages(t: Tables, requires):
    pkgs = P.package_graph(V.v_dists(t), requires)
    refs = extract.extract_refs(V.v_apps(t))
    d = V.v_dists(t).select("name", "version", "license", "classifiers_txt")
    return pkgs, P.package_roots(pkgs, audit.classify_refs(refs, d)).checkpoint(eager=True)


@register("package_tree", _BRANCHES + """
SELECT r.name AS root, t.depth, p.name AS parent, n.name AS node, n.version, t.recursive, t.names AS path
FROM t JOIN o_pkg r ON r.norm = t.root JOIN o_pkg n ON n.norm = t.node LEFT JOIN o_pkg p ON p.norm = t.parent""", _named("v_tree_requires"))
def q_package_tree(spark, sf_dir):
    """G1 by name: every branch from the imported packages."""
    t = Tables(spark, sf_dir)
    tree = P.package_tree(*_packages(t, V.v_tree_requires(t)))
    return tree.select("root", "depth", "parent", "node", "version", "recursive", F.array_join("names", ">").alias("path"))


@register("package_display", _BRANCHES + """,
lab AS (SELECT root, node, min(path) AS label FROM t WHERE NOT recursive GROUP BY root, node),
x AS (
  SELECT root, 0 AS depth, CAST(NULL AS VARCHAR) AS parent, node, false AS repeated FROM t WHERE depth = 0
  UNION ALL
  SELECT l.root, len(l.label), l.node, e.dst, c.label <> list_append(l.label, e.dst)
  FROM lab l JOIN o_req e ON e.src = l.node JOIN lab c ON c.root = l.root AND c.node = e.dst)
SELECT r.name AS root, x.depth::INTEGER AS depth, p.name AS parent, n.name AS node, n.version, x.repeated, false AS missing
FROM x JOIN o_pkg r ON r.norm = x.root JOIN o_pkg n ON n.norm = x.node LEFT JOIN o_pkg p ON p.norm = x.parent
UNION ALL SELECT norm, 0, NULL, norm, NULL, false, true FROM o_gone""", _named("v_tree_requires"))
def q_package_display(spark, sf_dir):
    """G3 by name: the display tree, children in name order."""
    t = Tables(spark, sf_dir)
    return P.package_display(*_packages(t, V.v_tree_requires(t)))


_REACH = """
WITH RECURSIVE r(norm) AS (
  SELECT norm FROM o_app
  UNION
  SELECT e.{to} FROM r JOIN o_req e ON e.{of} = r.norm)
SELECT name AS node, version FROM r JOIN o_pkg USING (norm)"""


@register("package_reach", _REACH.format(to="dst", of="src"), _named("v_requires"))
def q_package_reach(spark, sf_dir):
    """G2 by name: all packages that the imported ones need."""
    t = Tables(spark, sf_dir)
    return P.package_reach(*_packages(t, V.v_requires(t)))


@register("package_dependents", _REACH.format(to="src", of="dst"), _named("v_requires"))
def q_package_dependents(spark, sf_dir):
    """G2 by name: all packages that need an imported one."""
    t = Tables(spark, sf_dir)
    return P.package_reach(*_packages(t, V.v_requires(t)), direction="in")


@register("depgraph_summary", """
WITH RECURSIVE r(node) AS (
  SELECT node FROM o_roots
  UNION
  SELECT e.dst FROM r JOIN o_edges e ON e.src = r.node)
SELECT (SELECT count(*) FROM o_roots) AS n_roots, (SELECT count(*) FROM r) AS n_reachable""", _G)
def q_depgraph_summary(spark, sf_dir):
    """A7, graph part: number of root packages and of distinct packages
    reachable from them (roots included)."""
    edges, roots, inst = _graph(Tables(spark, sf_dir))
    reach = G.reachable(edges, roots, inst)
    counts = (roots.select(F.lit(1).alias("is_root"))
              .unionByName(reach.select(F.lit(0).alias("is_root"))))
    return counts.agg(F.count_if(F.col("is_root") == 1).alias("n_roots"),
                      F.count_if(F.col("is_root") == 0).alias("n_reachable"))
