"""The file source against a walk of the same tree."""

import os

import pytest
from pyspark.sql import functions as F

from repolens.sources import corpus as C
from repolens.sources import files as S


@pytest.fixture()
def tree(tmp_path):
    root = tmp_path / "a tree"
    data = {"r1/_version.py": "v = 1", "r1/__main__.py": "main()", "r1/__init__.py": "", "r1/.env": "K=1", "r1/.git/config": "[core]", "r1/pkg/sub/.hidden/_x.py": "x",
            "r2/ünï/ä b%20.py": "é", "r2/data.json": "{}", "r2/mod.pyc": "p", "top.py": "t", "r2/empty.py": ""}
    for p, text in data.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(text, encoding="utf-8")
    (root / "r2/bad.py").write_bytes(b"\xff\xfe\x00bad")
    (root / "r2/none").mkdir()
    os.symlink(root, root / "r2/loop", target_is_directory=True)
    return root, data


def _rows(df):
    return {(r["repo"], r["path"]): (r["content"], r["error"]) for r in df.collect()}


def _split(p):
    return (p.split("/")[0], p.split("/", 1)[-1])


def test_every_name_comes_back(spark, tree):
    root, data = tree
    want = {_split(p): (t, None) for p, t in data.items()} | {("r2", "bad.py"): (None, C.DECODE_ERROR)}
    for where in (str(root), f"{root}/", root.as_uri().replace("%20", " ")):
        assert _rows(C.read_corpus(spark, where)) == want
    seen = set(_rows(C.read_corpus(spark, str(root / "r1"), names="visible")))
    assert seen == set()  # every name below r1 is hidden there


def test_filters_work_in_the_listing(spark, tree):
    root, data = tree
    got = S.list_files(spark, str(root), glob="*.{py,json}", skip_dirs=[".git", "sub"])
    want = {p: len(t.encode()) for p, t in data.items() if p.endswith((".py", ".json")) and "/sub/" not in p} | {"r2/bad.py": 6}
    assert {r["path"]: r["size"] for r in got.collect()} == want
    assert S.list_files(spark, str(root / "r2/none")).count() == 0
    assert C.read_corpus(spark, str(root / "r2/none")).count() == 0
    with pytest.raises(Exception, match="(?i)not.?found|no such|non-existing"):
        S.list_files(spark, str(root / "missing")).count()


def test_files_are_packed_by_bytes(spark, monkeypatch):
    sizes = [10] * 300 + [5000, 3] + [100] * 50
    df = spark.createDataFrame([(f"f{i:04}", n) for i, n in enumerate(sizes)], "path string, size long").repartition(7)
    dealt = S.pack_by_bytes(df, F.col("size"), "path", target=1000)
    parts = [r["s"] for r in dealt.groupBy(F.spark_partition_id()).agg(F.sum("size").alias("s")).collect()]
    assert sum(parts) == sum(sizes) and dealt.count() == len(sizes)
    assert sorted(parts)[-2] < 1000 + 100 and max(parts) < 5000 + 1000 and dealt.rdd.getNumPartitions() == sum(sizes) // 1000 + 1


def test_round_trip_and_unreadable_files(spark, tmp_path):
    rows = [("a/_b.py", "x"), ("a/.c/d", None), ("e", "é" * 100_000)]
    root = str(tmp_path / "out")
    assert S.write_files(spark.createDataFrame(rows, "path string, content string"), root) == (3, 200_001)
    files = S.list_files(spark, root)
    got = {r["path"]: r["content"] for r in S.read_files(spark, root, files).collect()}
    assert got == {p: t or "" for p, t in rows}
    gone = S.read_files(spark, root, files.union(spark.createDataFrame([("gone", 3), ("huge", 1 << 40)], "path string, size long")))
    errors = {r["path"]: r["error"] for r in gone.collect() if r["error"]}
    assert set(errors) == {"gone", "huge"} and "larger" in errors["huge"]
    with pytest.raises(Exception, match="not a path below"):
        S.write_files(spark.createDataFrame([("a/../../b", "x")], "path string, content string"), root)
