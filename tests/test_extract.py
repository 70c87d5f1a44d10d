"""Source extraction."""

from repolens.operators import extract as E

STRUCT_SRC = """
class TestClass:
    def method(self):
        pass

def function():
    pass
"""

COVERAGE_SRC = '''
def hello_world():
    print("Hello")

class MyClass:
    def method_one(self, arg1):
        return arg1 * 2

    def method_two(self):
        """Existing docstring"""
        pass

async def my_async_func():
    def inner():
        ""
    await other_func()
'''


def _files(spark, rows):
    return spark.createDataFrame(rows, "path string, content string")


def test_extract_refs(spark):
    f = _files(spark, [("a.py", "import os\nimport httpx\nfrom yaml import load\nimport mypkg.cli"),
                       ("b.py", "from . import x\nfrom .y import z\nif True:\n    import json"),
                       ("c.py", "def broken(:\n")])
    got = sorted((r.path, r.ref) for r in E.extract_refs(f).collect())
    assert got == [("a.py", "httpx"), ("a.py", "mypkg"), ("a.py", "os"), ("a.py", "yaml"), ("b.py", "json")]


def test_extract_refs_carries_keys(spark):
    f = spark.createDataFrame([("r1", "a.py", "import os")], "repo string, path string, content string")
    assert [(r.repo, r.path, r.ref) for r in E.extract_refs(f, keys=["repo", "path"]).collect()] == [("r1", "a.py", "os")]


def test_extract_structure(spark):
    f = _files(spark, [("t.py", STRUCT_SRC), ("bad.py", "class (:")])
    rows = {r.path: [] for r in []}
    for r in E.extract_structure(f).orderBy("path", "pos").collect():
        rows.setdefault(r.path, []).append((r.kind, r.name, r.members, r.lineno))
    assert rows["t.py"] == [("class", "TestClass", ["method"], 2), ("function", "function", [], 6)]
    assert rows["bad.py"][0][0] == "error" and rows["bad.py"][0][1].startswith("Error parsing AST")


def test_structure_imports_and_async(spark):
    src = "import a.b, c\nfrom . import y\nfrom m import n as k\nasync def f(): pass\nclass K:\n    async def g(self): pass\n"
    got = [(r.kind, r.name, r.members) for r in E.extract_structure(_files(spark, [("x.py", src)])).orderBy("pos").collect()]
    assert got == [("import", "a.b", None), ("import", "c", None), ("import", ".y", None), ("import", "m.n", None),
                   ("class", "K", [])]


def test_find_function(spark):
    src = "class A:\n    def run(self):\n        return 1\ndef run():\n    return 2\nasync def later():\n    pass\n"
    f = _files(spark, [("x.py", src)])
    req = spark.createDataFrame([("x.py", "run"), ("x.py", "later"), ("x.py", "nope")], "path string, function_name string")
    got = {r.function_name: (r.found, r.code) for r in E.find_function(f, req).collect()}
    assert got["run"] == (True, "def run():\n    return 2")      # breadth first: module level before class body
    assert got["later"] == (False, "Function 'later' not found in x.py")
    assert got["nope"][0] is False


def test_docstring_coverage(spark):
    got = E.docstring_coverage(_files(spark, [("c.py", COVERAGE_SRC)])).collect()[0]
    # hello_world, method_one, method_two, my_async_func, inner (empty docstring counts as missing)
    assert (got.n_functions, got.n_missing) == (5, 4)


def test_extract_declared(spark):
    man = spark.createDataFrame([
        (1, '[project]\ndependencies = [\n    "httpx",\n    "unused-lib"\n]\n'),
        (2, "dependencies = [\n  'Foo_Bar>=1',\n  \"x[y]\",\n  \"after\"\n]\ndev = [\"pytest\", 'single']"),
        (3, "no deps here")], "repo_id bigint, manifest string")
    got = sorted((r.repo, r.name) for r in E.extract_declared(man).collect())
    # repo 2: the block stops at the first "]" (inside x[y]), dev keeps double-quoted items only
    assert got == [(1, "httpx"), (1, "unused-lib"), (2, "foo-bar"), (2, "pytest")]


def test_extract_project_name(spark):
    man = spark.createDataFrame([(1, '[project]\nname = "My_Tool"\ndependencies = []'), (2, "x = 1")],
                                "repo_id bigint, manifest string")
    assert [(r.repo, r.name) for r in E.extract_project_name(man).collect()] == [(1, "my-tool")]


def test_sql_udtfs(spark):
    from repolens.functions.udtf import register_udtfs

    register_udtfs(spark)
    _files(spark, [("a.py", "import os\nfrom x.y import z\n"), ("t.py", STRUCT_SRC), ("bad.py", "def (")]) \
        .createOrReplaceTempView("udtf_files")
    refs = spark.sql("SELECT f.path, t.ref FROM udtf_files f, LATERAL extract_refs(f.content) t").collect()
    assert sorted((r.path, r.ref) for r in refs) == [("a.py", "os"), ("a.py", "x")]
    st = spark.sql("SELECT t.kind, t.name, t.lineno FROM udtf_files f, LATERAL extract_structure(f.content) t "
                   "WHERE f.path = 't.py' ORDER BY t.pos").collect()
    assert [(r.kind, r.name, r.lineno) for r in st] == [("class", "TestClass", 2), ("function", "function", 6)]
    fns = spark.sql("SELECT t.name, t.has_docstring FROM udtf_files f, "
                    "LATERAL extract_functions(f.content, false) t WHERE f.path = 't.py'").collect()
    assert sorted(r.name for r in fns) == ["function", "method"]


def test_deep_files_keep_their_tokens(spark):
    total = "import os\ndef total():\n    return " + " + ".join(f"'a{k}'" for k in range(5000)) + "\nclass Last:\n    pass\n"
    chain = ("def pick(x):\n    if x == 0:\n        import a0\n" + "".join(f"    elif x == {k}:\n        import a{k}\n" for k in range(1, 1000))
             + "    else:\n\n        def inner():\n            return x\n")
    f = _files(spark, [("total.py", total), ("chain.py", chain)])
    refs = {(r.path, r.ref) for r in E.extract_refs(f).collect()}
    assert refs == {("total.py", "os")} | {("chain.py", f"a{k}") for k in range(1000)}
    shape = [(r.path, r.kind, r.name, r.lineno) for r in E.extract_structure(f).orderBy("path", "pos").collect()]
    assert shape == [("chain.py", "function", "pick", 1), ("total.py", "import", "os", 1), ("total.py", "function", "total", 2), ("total.py", "class", "Last", 4)]
    assert {r.path: (r.n_functions, r.n_missing) for r in E.docstring_coverage(f).collect()} == {"total.py": (1, 1), "chain.py": (2, 2)}
    req = spark.createDataFrame([("total.py", "total"), ("chain.py", "pick"), ("chain.py", "inner")], "path string, function_name string")
    got = {r.function_name: (r.found, r.code) for r in E.find_function(f, req).collect()}
    assert got == {"total": (True, "\n".join(total.split("\n")[1:3])), "pick": (True, chain.rstrip()), "inner": (True, "def inner():\n    return x")}
