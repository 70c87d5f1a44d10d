"""Dependency graphs of installed packages by name (G1, G2, G3 on J3).

Installed packages are numbered in the order of their normalised names (a
distributed rank), requirement edges (J3) and the roots (a project's external
references, U1 and J2) are mapped to these numbers, and the graph operators
work on numbers: paths and labels are integer arrays whose order is the order
of the names.  Names and versions come back at the end.

Two distributions of one normalised name are one package: the first by name
gives name and version, the requirements of both count.  A reference that is
not installed has no number; the display tree shows it as ``missing``, the
other operators leave it out.  Null names are no packages.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import alias_install_name, normalize_name
from . import graph
from .audit import installed_edges
from .summarize import distributed_row_number


@dataclass
class PackageGraph:
    """``nodes (node, norm, name, version)`` numbered in name order, and
    ``edges (src, dst)``; both are written."""

    nodes: DataFrame
    edges: DataFrame


def package_graph(dists: DataFrame, requires: DataFrame, key_col: str = "p_partkey") -> PackageGraph:
    """The graph of ``dists (key, name, version)`` and ``requires (key, requirement)``."""
    named = dists.select(F.col(key_col).alias("key"), "name", F.col("version"), normalize_name("name", strip_extras=False).alias("norm")).where(F.col("norm").isNotNull())
    one = named.groupBy("norm").agg(F.min(F.struct("name", "version")).alias("d")).select(F.lit(0).alias("all"), "norm", "d.name", "d.version")
    nodes = (distributed_row_number(one, ["all"], "norm", "node")
             .select(F.col("node").cast("bigint").alias("node"), "norm", "name", "version").checkpoint(eager=True))
    number = graph.by_key(nodes.select("norm", "node"))
    edges = (installed_edges(requires, dists, key_col).join(graph.by_key(named.select(F.col("key").alias("pkg"), "norm")), "pkg").join(number, "norm")
             .select(F.col("node").alias("src"), F.col("dep").alias("norm")).join(number, "norm").select("src", F.col("node").alias("dst")).distinct())
    return PackageGraph(nodes, edges.checkpoint(eager=True))


def package_roots(pkgs: PackageGraph, external: DataFrame, aliases: dict | None = None) -> DataFrame:
    """``(norm, node)`` of external references (``ref``, see
    ``audit.classify_refs``); node is null where nothing is installed."""
    names = external.select(normalize_name(alias_install_name("ref", aliases)).alias("norm")).where(F.col("norm").isNotNull()).distinct()
    return names.join(graph.by_key(pkgs.nodes.select("norm", "node")), "norm", "left")


def _named(rows: DataFrame, pkgs: PackageGraph, version_of: str, *cols: str) -> DataFrame:
    """Numbers in ``cols`` to names; ``version`` is that of ``version_of``."""
    for c in cols:
        n = pkgs.nodes.select(F.col("node").alias(f"_{c}"), F.col("name").alias(f"{c}_name"), F.col("version").alias(f"{c}_version"))
        rows = rows.join(graph.by_key(n), F.col(c) == F.col(f"_{c}"), "left").drop(f"_{c}")
    keep = [c for c in rows.columns if not c.endswith(("_name", "_version")) and c not in cols]
    return rows.select(*[F.col(f"{c}_name").alias(c) for c in cols], F.col(f"{version_of}_version").alias("version"), *keep)


def package_tree(pkgs: PackageGraph, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """G1: ``root, parent, node, version, depth, recursive, names`` (the
    branch's names from the root on).  The walk runs on names, one for each
    package, and takes the versions along."""
    nodes = pkgs.nodes.select("node", "name", "version")
    to = nodes.select(F.col("node").alias("dst"), F.col("name").alias("dst_name"), "version")
    of = nodes.select(F.col("node").alias("src"), F.col("name").alias("src_name"))
    edges = (pkgs.edges.join(graph.by_key(to), "dst").join(graph.by_key(of), "src")
             .select(F.col("src_name").alias("src"), F.col("dst_name").alias("dst"), "version"))
    start = roots.select("node").join(graph.by_key(nodes), "node").select(F.col("name").alias("node"), "version")
    tree = graph.dep_tree(edges, start, max_depth=max_depth, tag="version")
    return tree.select("root", "parent", "node", "version", "depth", "recursive", F.col("path").alias("names"))


def package_reach(pkgs: PackageGraph, roots: DataFrame, direction: str = "out") -> DataFrame:
    """``node, version`` of every package reached, roots included."""
    return _named(graph.reachable(pkgs.edges, roots.where(F.col("node").isNotNull()), direction=direction), pkgs, "node", "node")


def package_display(pkgs: PackageGraph, roots: DataFrame) -> DataFrame:
    """``root, parent, node, version, depth, repeated, missing`` with
    children in name order; a root that is not installed is one ``missing`` row."""
    shown = graph.preorder_tree(pkgs.edges, roots.where(F.col("node").isNotNull()), as_text=False)
    rows = _named(shown, pkgs, "node", "root", "parent", "node")
    gone = roots.where(F.col("node").isNull()).select(
        F.col("norm").alias("root"), F.lit(None).cast("string").alias("parent"), F.col("norm").alias("node"), F.lit(None).cast("string").alias("version"),
        F.lit(0).alias("depth"), F.lit(False).alias("repeated"), F.lit(True).alias("missing"))
    return rows.unionByName(gone)
