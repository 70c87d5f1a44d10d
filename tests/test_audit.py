"""Package resolution, classification, reference index, integrity check."""

import pytest

from repolens.operators import audit as A


def _dists(spark):
    return spark.createDataFrame([
        ("httpx", "0.27", "BSD-3-Clause", []),
        ("PyYAML", "6.0", "UNKNOWN", ["Topic :: X", "License :: OSI Approved :: MIT License"]),
        ("pytest", "8.0", None, []),
        ("weird_pkg", "1.0", "n/a", ["License :: Other :: unknown"])],
        "name string, version string, license string, classifiers array<string>")


def test_resolve_and_classify(spark):
    refs = spark.createDataFrame([("a.py", r) for r in ["httpx", "yaml", "os", "mystery", "pytest", "weird_pkg"]],
                                 "path string, ref string")
    res = {r.ref: (r.install_name, r.installed, r.version, r.license)
           for r in A.resolve_packages(refs, _dists(spark)).collect()}
    assert res["httpx"] == ("httpx", True, "0.27", "BSD-3-Clause")
    assert res["yaml"] == ("PyYAML", True, "6.0", "MIT License")
    assert res["pytest"][3] == "MIT"
    assert res["weird_pkg"][3] == "Unknown"
    assert res["mystery"] == ("mystery", False, None, None)
    ext = {r.ref: (r.version, r.license) for r in A.classify_refs(refs, _dists(spark)).collect()}
    assert "os" not in ext
    assert ext["mystery"] == ("Internal/Unknown", "N/A")
    assert ext["yaml"] == ("6.0", "MIT License")


def test_installed_metadata_beats_stdlib(spark):
    dists = spark.createDataFrame([("os", "1.0", "MIT", [])],
                                  "name string, version string, license string, classifiers array<string>")
    refs = spark.createDataFrame([("a.py", "os")], "path string, ref string")
    assert [r.version for r in A.classify_refs(refs, dists).collect()] == ["1.0"]


def test_ref_index_long_form(spark):
    refs = spark.createDataFrame([("a.py", "httpx"), ("b.py", "httpx"), ("b.py", "os"), ("b.py", "httpx")],
                                 "path string, ref string")
    ext = A.classify_refs(refs, _dists(spark))
    got = sorted((r.ref, r.path, r.n_files) for r in A.ref_index(refs, ext).collect())
    assert got == [("httpx", "a.py", 2), ("httpx", "b.py", 2)]


def test_integrity_check_reference_example(spark):
    declared = spark.createDataFrame([("p", "httpx"), ("p", "unused-lib"), ("p", "setuptools")], "repo string, name string")
    refs = spark.createDataFrame([("p", "httpx"), ("p", "undeclared_lib"), ("p", "os"), ("p", "yaml"), ("q", "zzz")],
                                 "repo string, ref string")
    used = A.used_install_names(refs)
    report = A.integrity_check(declared, used)
    got = sorted((r.repo, r.kind, r.name) for r in report.collect())
    assert got == [("p", "undeclared", "pyyaml"), ("p", "undeclared", "undeclared-lib"), ("p", "unused", "unused-lib")]
    with pytest.raises(A.IntegrityError):
        A.integrity_gate(report)
    A.integrity_gate(report.where("false"))


def test_manifest_without_declarations_still_reported(spark):
    declared = spark.createDataFrame([], "repo string, name string")
    used = spark.createDataFrame([("p", "httpx")], "repo string, name string")
    repos = spark.createDataFrame([("p",)], "repo string")
    got = [(r.kind, r.name) for r in A.integrity_check(declared, used, repos=repos).collect()]
    assert got == [("undeclared", "httpx")]


def test_installed_edges(spark):
    req = spark.createDataFrame([(1, 0, "Foo_Bar[extra]>=1"), (1, 1, "foo-bar<2"), (1, 2, "(bad"), (1, 3, "missing")],
                                "p_partkey bigint, pos int, requirement string")
    dists = spark.createDataFrame([("foo_bar",)], "name string")
    assert [(r.pkg, r.dep) for r in A.installed_edges(req, dists).collect()] == [(1, "foo-bar")]


def test_project_own_name_not_reported(spark):
    declared = spark.createDataFrame([("p", "my-tool"), ("p", "httpx")], "repo string, name string")
    used = spark.createDataFrame([("p", "httpx"), ("p", "my-tool-x")], "repo string, name string")
    own = spark.createDataFrame([("p", "my-tool"), ("p", "my-tool-x")], "repo string, name string")
    assert A.integrity_check(declared, used, project_names=own).count() == 0


def test_audit_summary_exact_and_approx(spark):
    files = spark.createDataFrame([("p", "a.py"), ("p", "b.py"), ("q", "c.py")], "repo string, path string")
    refs = spark.createDataFrame([("p", "a.py", "httpx"), ("p", "b.py", "httpx"), ("p", "b.py", "os"),
                                  ("q", "c.py", "zzz")], "repo string, path string, ref string")
    ext = spark.createDataFrame([("httpx",), ("zzz",)], "ref string")
    report = spark.createDataFrame([("p", "unused", "x")], "repo string, kind string, name string")
    for rsd in (None, 0.01):
        got = {r.repo: (r.n_files, r.n_refs, r.n_external, r.n_unused, r.n_undeclared)
               for r in A.audit_summary(files, refs, ext, report, approx_rsd=rsd).collect()}
        assert got == {"p": (2, 2, 1, 1, 0), "q": (1, 1, 1, 0, 0)}


def test_readme_audit_example_end_to_end(spark):
    """The README's usage path: file corpus -> prune -> AST refs -> classify -> index."""
    import os
    import uuid

    from repolens.operators import extract
    from repolens.sources.corpus import corpus_scan_pruned, read_corpus

    root = spark.sparkContext.getCheckpointDir().replace("file:", "").rstrip("/") + f"/corpus-{uuid.uuid4().hex}"
    for rel, body in [("r1/src/a.py", "import os\nimport httpx\nfrom yaml import load\n"), ("r2/b.py", "import httpx\n"),
                      ("r2/venv/c.py", "import secret\n")]:
        os.makedirs(os.path.dirname(os.path.join(root, rel)), exist_ok=True)
        with open(os.path.join(root, rel), "w") as f:
            f.write(body)
    files = corpus_scan_pruned(read_corpus(spark, root, glob="*.py"), "audit", path_has_repo=False)
    refs = extract.extract_refs(files, keys=["repo", "path"]).checkpoint()
    dists = spark.createDataFrame([("httpx", "0.27", "BSD", [])],
                                  "name string, version string, license string, classifiers array<string>")
    external = A.classify_refs(refs, dists)
    got = sorted(map(tuple, A.ref_index(refs, external, group_cols=["repo"]).collect()))
    assert got == [("r1", "httpx", "src/a.py", 1), ("r1", "yaml", "src/a.py", 1), ("r2", "httpx", "b.py", 1)]
