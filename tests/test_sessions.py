"""Permissions, history, context reset, mentions, test lookup, path search."""

from pyspark.sql import functions as F

from repolens.operators import sessions as SS


def test_sticky_permissions_sequence(spark):
    log = spark.createDataFrame([
        ("s", 1, "read_file", None), ("s", 2, "run_command", "n"), ("s", 3, "run_command", "y"),
        ("s", 4, "run_command", "always"), ("s", 5, "run_command", "n"), ("s", 6, "write_file", "n"),
        ("t", 1, "write_file", "session"), ("t", 2, "write_file", "n"), ("t", 3, "run_command", "n"),
        ("t", 4, "run_command", None)], "session string, seq bigint, tool string, choice string")
    got = {(r.session, r.seq): (r.allowed, r.asked) for r in SS.sticky_permissions(log).collect()}
    assert got[("s", 1)] == (True, False)
    assert got[("s", 2)] == (False, True)
    assert got[("s", 3)] == (True, True)
    assert got[("s", 4)] == (True, True)
    assert got[("s", 5)] == (True, False)   # sticky after "always"
    assert got[("s", 6)] == (False, True)   # other tools are not affected
    assert got[("t", 2)] == (True, False)   # "session" sets only the current tool
    assert got[("t", 3)] == (False, True)
    assert got[("t", 4)] == (False, True)   # no answer denies


def test_history_and_clear(spark):
    msgs = spark.createDataFrame([(1, 0, "system", "SysPrompt"), (1, 1, "user", "Hi"), (1, 2, "assistant", "Hello"),
                                  (1, 3, "assistant", None)], "conv_id bigint, turn bigint, role string, text string")
    prev = [r.preview for r in SS.history(msgs).orderBy("turn").collect()]
    assert prev == ["[system]: SysPrompt...", "[user]: Hi...", "[assistant]: Hello...", "[assistant]: "]
    first = SS.reset_context(msgs).collect()
    assert len(first) == 1 and first[0].text == "SysPrompt"


def test_history_tool_calls(spark):
    msgs = spark.createDataFrame([(1, 0, "assistant", "", ["a", "b"])],
                                 "conv_id bigint, turn bigint, role string, text string, calls array<string>")
    assert SS.history(msgs, tool_calls_col="calls").collect()[0].preview == "[assistant]: <2 tool calls>"


def test_inject_mentions(spark):
    files = spark.createDataFrame([("README.md", "Secret Content"), ("src/a.py", "x = 1")], "path string, content string")
    texts = spark.createDataFrame([(1, "Analyze @src/a.py now"), (2, "Check @@README.md"), (3, "plain"),
                                   (4, "mail me@missing.txt or @"), (5, "Check @README.md.")],
                                  "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in SS.inject_mentions(texts, files).collect()}
    assert got[1] == "Analyze \n--- Context from src/a.py ---\nx = 1\n---------------------------------\n now"
    assert got[2] == "Check @\n--- Context from README.md ---\nSecret Content\n---------------------------------\n"
    assert got[3] == "plain"
    assert got[4] == "mail me@missing.txt or @"
    assert got[5] == "Check @README.md."   # the trailing dot is part of the name: not found


def test_test_coverage(spark):
    files = spark.createDataFrame([("pkg/m1.py",), ("pkg/tests/test_m1.py",), ("tests/test_m1.py",),
                                   ("pkg/m2.py",), ("m3.py",), ("test_m3.py",)], "path string")
    src = files.where(~F.element_at(F.split("path", "/"), -1).startswith("test_"))
    got = {r.source: (r.exists, r.path) for r in SS.test_coverage(src, files).collect()}
    assert got["pkg/m1.py"] == (True, "pkg/tests/test_m1.py")
    assert got["pkg/m2.py"] == (False, "tests/test_m2.py")
    assert got["m3.py"] == (True, "test_m3.py")


def _brute_search(paths, q, k):
    q = q.lower()
    opts = sorted({"@" + p for p in paths if q in p.lower()},
                  key=lambda x: (len(x.split("/")), x.lower(), x))
    return opts[:k]


def test_path_search_matches_brute_force(spark):
    import random

    rnd = random.Random(5)
    parts = ["src", "lib", "Main", "util", "a", "README", "x.py", "ab", "tests"]
    paths = sorted({"/".join(rnd.choice(parts) for _ in range(rnd.randint(1, 4))) for _ in range(300)})
    queries = ["", "a", "ab", "MAIN", "src/", "util/x", "zzz", "py", "s/a"]
    f = spark.createDataFrame([(p,) for p in paths], "path string")
    q = spark.createDataFrame([(x,) for x in queries], "query string")
    got = {}
    for r in SS.path_search(f, q, 7).collect():
        got.setdefault(r.query, []).append((r.rank, r.option))
    for query in queries:
        want = _brute_search(paths, query, 7)
        have = [o for _, o in sorted(got.get(query.lower(), []))]
        assert have == want, query


def test_fill_missing(spark):
    methods = spark.createDataFrame([(1, "it's \"\"\"doc\"\"\" text"), (2, "other")], "doc_id bigint, text string")
    existing = spark.createDataFrame([(2, "old")], "doc_id bigint, docstring string")
    got = {r.doc_id: (r.docstring, r.action) for r in SS.fill_missing(methods, existing, F.col("text")).collect()}
    assert got == {1: ("its doc text", "generated"), 2: ("old", "kept")}
    got = {r.doc_id: (r.docstring, r.action)
           for r in SS.fill_missing(methods, existing, F.col("text"), overwrite=True).collect()}
    assert got[2] == ("other\nold", "prepended")
