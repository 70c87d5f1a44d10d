"""Dependency audit over many repositories.

Inputs are long tables: references ``(repo?, path, ref)``, installed
distributions ``(name, version, license, classifiers)``, a standard-library
name table, alias pairs and declared names.  Every dimension join is a plain
equi join; Spark/AQE decide broadcast versus sort-merge from the measured
size, so nothing is broadcast on faith.  The fixed name lists (aliases,
stdlib, tool-only) are tiny literals and become ``isin``/map expressions, not
joins.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import (IMPORT_ALIASES, SELF_NAMES, STDLIB_COMMON, TOOL_ONLY, alias_install_name,
                               normalize_name, requirement_name, resolve_license)


def _dist_dim(dists: DataFrame) -> DataFrame:
    """``norm, version, license (resolved), install_name`` keyed by normalized name."""
    cls = (F.col("classifiers") if "classifiers" in dists.columns
           else F.when(F.col("classifiers_txt").isNull() | (F.col("classifiers_txt") == ""),
                       F.array().cast("array<string>")).otherwise(F.split("classifiers_txt", r"\|")))
    lic = F.col("license") if "license" in dists.columns else F.lit(None).cast("string")
    # Resolve the license per distribution first, so the de-duplication below
    # aggregates strings only (hash aggregation, no sort).
    d = dists.select(F.col("name").alias("dist_name"), "version",
                     resolve_license(lic, cls, F.col("name")).alias("license"))
    d = d.withColumn("norm", normalize_name("dist_name", strip_extras=False))
    # One row per normalized name (first by name) so the lookup cannot fan out.
    d = d.groupBy("norm").agg(F.min_by(F.struct("dist_name", "version", "license"), "dist_name").alias("d"))
    return d.select("norm", "d.dist_name", "d.version", "d.license")


def _install_name(refs: DataFrame, aliases: DataFrame | dict | None) -> DataFrame:
    if isinstance(aliases, DataFrame):
        a = aliases.select(F.col("alias").alias("ref"), "install_name").dropDuplicates(["ref"])
        out = refs.join(a, "ref", "left")
        return out.withColumn("install_name", F.coalesce("install_name", "ref"))
    return refs.withColumn("install_name", alias_install_name("ref", aliases))


def resolve_packages(refs: DataFrame, dists: DataFrame, aliases: DataFrame | dict | None = None) -> DataFrame:
    """Distinct reference -> install name (alias table), version and
    resolved license; null version/license when not installed."""
    r = refs.select("ref").distinct()
    r = _install_name(r, aliases)
    r = r.withColumn("norm", normalize_name("install_name", strip_extras=False))
    out = r.join(_dist_dim(dists), "norm", "left")
    return out.select("ref", "install_name", F.col("dist_name").isNotNull().alias("installed"),
                      "version", "license")


def classify_refs(refs: DataFrame, dists: DataFrame, stdlib: DataFrame | list | None = None,
                  aliases: DataFrame | dict | None = None) -> DataFrame:
    """Installed -> external with its info; else standard library ->
    dropped; else external ``Internal/Unknown`` with license ``N/A``.

    ``stdlib`` is a DataFrame with a ``name`` column or a list of names
    (default: the fixed common list).  Names are compared as written.
    """
    res = resolve_packages(refs, dists, aliases)
    if isinstance(stdlib, DataFrame):
        std = stdlib.select(F.col("name").alias("ref")).distinct()
        unresolved_std = res.where(~F.col("installed")).join(std, "ref", "left_semi").select("ref")
        res = res.join(unresolved_std, "ref", "left_anti")
    else:
        names = STDLIB_COMMON + sorted(sys.builtin_module_names) if stdlib is None else list(stdlib)
        res = res.where(F.col("installed") | ~F.col("ref").isin(*names))
    return res.select("ref",
                      F.when(F.col("installed"), F.col("version")).otherwise(F.lit("Internal/Unknown")).alias("version"),
                      F.when(F.col("installed"), F.col("license")).otherwise(F.lit("N/A")).alias("license"))


def ref_index(refs: DataFrame, external: DataFrame, group_cols=()) -> DataFrame:
    """A1: reference -> files that use it (external references only), with
    the number of distinct files, in long form ``(…, ref, path, n_files)``.

    Long form is the primary output: a reference used by nearly every file
    would otherwise become one giant array in one task.  The per-reference
    count is a partial/final aggregate (map-side combine), joined back on the
    reference; AQE's skew-join handling splits a hot reference.
    """
    keys = list(group_cols)
    r = refs.select(*keys, "ref", "path").distinct().join(external.select("ref").distinct(), "ref", "left_semi")
    counts = r.groupBy(*keys, "ref").agg(F.count("*").alias("n_files"))
    return r.join(counts, keys + ["ref"])


def ranked_listing(index: DataFrame, info: DataFrame) -> DataFrame:
    """Library listing sorted by library then file, with ``Unknown``
    defaults for missing version or license.  Sorting is a global range
    sort, so a hot library spans several partitions."""
    out = index.join(info.select("ref", "version", "license"), "ref", "left")
    return (out.select(F.col("ref").alias("library"),
                       F.coalesce("version", F.lit("Unknown")).alias("version"),
                       F.coalesce("license", F.lit("Unknown")).alias("license"),
                       "path", "n_files")
            .orderBy("library", "path"))


def installed_edges(requires: DataFrame, dists: DataFrame, pkg_col: str = "p_partkey") -> DataFrame:
    """Requirement edges whose target is installed, deduplicated per
    package: ``(pkg, dep)`` with ``dep`` the normalized target name."""
    r = requires.select(F.col(pkg_col).alias("pkg"), requirement_name("requirement").alias("req"))
    r = r.where(F.col("req").isNotNull()).select("pkg", normalize_name("req", strip_extras=False).alias("dep"))
    inst = dists.select(normalize_name("name", strip_extras=False).alias("dep")).distinct()
    return r.join(inst.hint("merge"), "dep", "left_semi").select("pkg", "dep").distinct()


def used_install_names(external_refs: DataFrame, aliases: dict | None = None) -> DataFrame:
    """Used (repo, name) on normalized install names, from external refs."""
    a = {k: v.lower() for k, v in (IMPORT_ALIASES if aliases is None else aliases).items()}
    return external_refs.select("repo", normalize_name(alias_install_name("ref", a), strip_extras=False)
                                .alias("name")).distinct()


def integrity_check(declared: DataFrame, used: DataFrame, repos: DataFrame | None = None, tool_only=None,
                    stdlib=None, self_names=None, project_names: DataFrame | None = None) -> DataFrame:
    """Per repository, ``unused`` = declared - used - tool list and
    ``undeclared`` = used - declared - stdlib list - project names, compared
    on normalized install names.  Repositories without a manifest (absent from
    ``repos``, default: those with a declared name) get no report; a manifest
    that declares nothing still gets one.  A repository's own project name
    (``project_names``: ``repo, name``, e.g. from ``extract.extract_project_name``)
    is never reported either way.  Output ``repo, kind, name``."""
    tool_only = TOOL_ONLY if tool_only is None else list(tool_only)
    stdlib = STDLIB_COMMON if stdlib is None else list(stdlib)
    self_names = SELF_NAMES if self_names is None else list(self_names)
    dec = declared.select("repo", "name").distinct()
    have = (repos if repos is not None else dec).select("repo").distinct()
    use = used.select("repo", "name").distinct().join(have, "repo", "left_semi")
    unused = (dec.join(use, ["repo", "name"], "left_anti").where(~F.col("name").isin(*tool_only))
              .withColumn("kind", F.lit("unused")))
    undeclared = (use.join(dec, ["repo", "name"], "left_anti")
                  .where(~F.col("name").isin(*(stdlib + self_names)))
                  .withColumn("kind", F.lit("undeclared")))
    out = unused.unionByName(undeclared).select("repo", "kind", "name")
    if project_names is not None:
        out = out.join(project_names.select("repo", "name").distinct(), ["repo", "name"], "left_anti")
    return out


def integrity_counts(report: DataFrame) -> DataFrame:
    """X2 as a table: per repository, counts of unused and undeclared names
    and whether the gate fails."""
    agg = report.groupBy("repo").agg(F.count_if(F.col("kind") == "unused").alias("n_unused"),
                                     F.count_if(F.col("kind") == "undeclared").alias("n_undeclared"))
    return agg.withColumn("failed", (F.col("n_unused") + F.col("n_undeclared")) > 0)


class IntegrityError(RuntimeError):
    pass


def integrity_gate(report: DataFrame) -> None:
    """Fail the run when any row is reported (reads at most one row)."""
    if report.limit(1).count() > 0:
        raise IntegrityError("dependency integrity check reported unused or undeclared packages")


def audit_summary(files: DataFrame, refs: DataFrame, external: DataFrame, report: DataFrame,
                  approx_rsd: float | None = None) -> DataFrame:
    """Per repository: files scanned, distinct references, distinct
    external libraries, unused and undeclared counts.  With ``approx_rsd``
    the distinct reference count uses HyperLogLog++
    (``approx_count_distinct``, that relative standard deviation) instead of
    an exact distinct -- cheaper when repositories are huge."""
    f = files.groupBy("repo").agg(F.count("*").alias("n_files"))
    n_refs = (F.approx_count_distinct("ref", approx_rsd) if approx_rsd else F.count_distinct("ref")).alias("n_refs")
    r = refs.groupBy("repo").agg(n_refs)
    e = (refs.select("repo", "ref").distinct().join(external.select("ref").distinct(), "ref", "left_semi")
         .groupBy("repo").agg(F.count("*").alias("n_external")))
    c = integrity_counts(report).select("repo", "n_unused", "n_undeclared")
    out = f.join(r, "repo", "left").join(e, "repo", "left").join(c, "repo", "left")
    return out.select("repo", "n_files", *[F.coalesce(c, F.lit(0)).alias(c) for c in
                                           ("n_refs", "n_external", "n_unused", "n_undeclared")])
