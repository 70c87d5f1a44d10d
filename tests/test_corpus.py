"""Corpus scans and path predicates."""

import os
import tempfile


from repolens.functions import text as X
from repolens.sources import corpus as C


def _paths(spark, paths):
    return spark.createDataFrame([(p,) for p in paths], "path string")


def test_scan_default_and_empty_ignore_lists(spark):
    df = _paths(spark, ["file1.py", "file2.txt", "subdir/file3.py", "__init__.py", "test.pyc", "x.pyo", "a.pycache"])
    assert sorted(r.path for r in C.corpus_scan(df).collect()) == ["file1.py", "file2.txt", "subdir/file3.py"]
    assert C.corpus_scan(df, ignore_extensions=[], ignore_files=[]).count() == 7


def test_read_corpus_reads_every_name(spark):
    root = tempfile.mkdtemp(prefix="repolens-corpus-")
    os.makedirs(os.path.join(root, "repo1", "pkg"))
    for rel, body in [("repo1/pkg/a.py", "import os\n"), ("repo1/README.md", "hi"), ("repo1/pkg/__init__.py", "")]:
        with open(os.path.join(root, rel), "w") as f:
            f.write(body)
    df = C.read_corpus(spark, root)
    got = {(r.repo, r.path): r.content for r in df.collect()}
    assert got[("repo1", "pkg/a.py")] == "import os\n"
    # Every name comes back; only Spark's own listing hides "_" and ".".
    assert len(got) == 3 and got[("repo1", "pkg/__init__.py")] == ""
    assert {r.path for r in C.read_corpus(spark, root, glob="*.py").collect()} == {"pkg/a.py", "pkg/__init__.py"}
    assert {r.path for r in C.read_corpus(spark, root, glob="*.py", names="visible").collect()} == {"pkg/a.py"}


def test_security_predicates(spark):
    paths = _paths(spark, [".env", "config/.env", "secret.env.py", "ok.py"])
    assert [r.path for r in paths.where(X.is_safe_path("path")).collect()] == ["ok.py"]
    cmds = spark.createDataFrame([(c,) for c in ["env", "cat .env", "printenv", "ls", "export X=1", "set -x",
                                                 "environment", "ls ./.env", "unset A", "echo settle"]], "c string")
    got = {r.c: r.safe for r in cmds.select("c", X.is_safe_command("c").alias("safe")).collect()}
    assert got == {"env": False, "cat .env": False, "printenv": False, "ls": True, "export X=1": False,
                   "set -x": False, "environment": True, "ls ./.env": False, "unset A": False, "echo settle": True}


def test_command_words_unicode_boundaries(spark):
    import re

    words = ["the", "and"]
    texts = ["the end", "théand", "ñand", "and_x", "x-and", "1the", "ThE"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.safe for r in df.select("t", X.is_safe_command("t", words).alias("safe")).collect()}
    for t in texts:
        py = not any(re.search(rf"\b{re.escape(w)}\b", t.lower()) for w in words)
        assert got[t] == py, t


def test_prune_profiles(spark):
    df = spark.createDataFrame([("r", "r/src/a.py"), ("r", "r/venv/b.py"), ("r", "r/lib/c.py"), ("r", "r/x/.env/d.py"),
                                ("r", "r/src/secret.env.py"), ("r", "r/src/__init__.py"), ("r", "r/build/e.txt"),
                                ("r", "r/src/f.pyc"), ("r", "r/.DS_Store"), ("r", "r/.pytest_cache/g.py")],
                               "repo string, path string")
    audit = {r.rel_path for r in C.corpus_scan_pruned(df, "audit").collect()}
    assert audit == {"src/a.py", "x/.env/d.py", "src/secret.env.py", ".pytest_cache/g.py"}
    finder = {r.rel_path for r in C.corpus_scan_pruned(df, "source_finder").collect()}
    assert finder == {"src/a.py", "src/__init__.py", "lib/c.py", ".pytest_cache/g.py"}
    overview = {r.rel_path for r in C.corpus_scan_pruned(df, "overview").collect()}
    assert overview == {"src/a.py", "lib/c.py", "x/.env/d.py", "src/secret.env.py", "src/__init__.py"}
    mention = {r.rel_path for r in C.corpus_scan_pruned(df, "mention_index").collect()}
    assert mention == {"src/a.py", "lib/c.py", "x/.env/d.py", "src/secret.env.py", "src/__init__.py", ".DS_Store"}


def test_dir_listing_and_structure(spark):
    df = spark.createDataFrame([("r", "r/a/b.py"), ("r", "r/a/c/.env"), ("r", "r/a/c/d.txt"), ("r", "r/top.py"),
                                ("r", "r/.git/x.py"), ("r", "r/e/.git/y.py")], "repo string, path string")
    listing = {(r.directory, r.child) for r in C.dir_listing(df).collect()}
    assert ("r/a", "b.py") in listing and ("r/a", "c") in listing and ("r/a/c", ".env") not in listing
    one = {r.child for r in C.dir_listing(df, "r/a").collect()}
    assert one == {"b.py", "c"}
    st = {(r.kind, r.path) for r in C.project_structure(df).collect()}
    # "e" is reached by the walk even though all it holds is pruned
    assert st == {("directory", "a"), ("directory", "a/c"), ("directory", "e"), ("python_file", "a/b.py"),
                  ("python_file", "top.py")}


def test_read_documents_errors(spark):
    files = spark.createDataFrame([("a.txt", "hello"), (".env", "SECRET")], "path string, content string")
    req = _paths(spark, ["a.txt", ".env", "config/.env", "missing.txt"])
    got = {r.path: (r.content, r.ok) for r in C.read_documents(req, files).collect()}
    assert got["a.txt"] == ("hello", True)
    assert "prohibited" in got[".env"][0].lower() and "prohibited" in got["config/.env"][0].lower()
    assert got["missing.txt"][0].startswith("Error reading file") and got["missing.txt"][1] is False


def test_text_functions(spark):
    df = spark.createDataFrame([("  ```python\nx = 1\n```  ",), ("```\n```",), ("plain ",), (None,), ("",),
                                ("```only```",)], "t string")
    got = [r.c for r in df.select(X.clean_fenced_text("t").alias("c")).collect()]
    assert got == ["x = 1", "", "plain", None, "", ""]
    long = "x" * 2001
    t = spark.createDataFrame([(long,), ("short",)], "t string").select(X.truncate_text("t").alias("t")).collect()
    assert t[0].t == "x" * 2000 + "\n... (truncated for brevity)" and t[1].t == "short"
    s = spark.createDataFrame([("it's \"\"\"x\"\"\"",)], "t string").select(X.sanitize_docstring("t").alias("t"))
    assert s.collect()[0].t == "its x"
    m = spark.createDataFrame([("see @café/x.py and @@README.md, @",)], "t string")
    assert m.select(X.extract_mentions("t").alias("m")).collect()[0].m == ["café/x.py", "README.md"]
    r = spark.createDataFrame([("D",)], "d string").select(X.render_template("a {diff} b", diff="d").alias("p"))
    assert r.collect()[0].p == "a D b"


def test_read_corpus_nested_root_bad_bytes_and_uri(spark, tmp_path):
    root = tmp_path / "corpora"
    inner = root / "lib" / "lib" / str(root).strip("/")
    inner.mkdir(parents=True)
    (inner / "deep.py").write_text("x = 1")
    (root / "lib" / "bad.py").write_bytes(b"\xff\xfe x")
    for where in (str(root), f"file://{root}", f"file:{root}/"):
        rows = {r.path: r for r in C.read_corpus(spark, where).collect()}
        assert set(rows) == {f"lib/{str(root).strip('/')}/deep.py", "bad.py"} and {r.repo for r in rows.values()} == {"lib"}
        assert rows["bad.py"].content is None and rows["bad.py"].error and rows[f"lib/{str(root).strip('/')}/deep.py"].error is None
    pruned = C.corpus_scan_pruned(C.read_corpus(spark, str(root)), "audit", path_has_repo=False)
    assert [r.path for r in pruned.collect()] == ["bad.py"]  # a real lib/ directory is pruned, not taken for the prefix
