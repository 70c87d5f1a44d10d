"""Change-set batching and summarising."""

import random

from repolens.operators import summarize as SM


def _sequential(items, small=500, size=3):
    batches, cur = [], []
    for path, diff in items:
        if len(diff) < small:
            cur.append(path)
            if len(cur) >= size:
                batches.append(cur)
                cur = []
        else:
            batches.append([path])
    if cur:
        batches.append(cur)
    return batches


def test_size_batches_matches_sequential_rule(spark):
    rnd = random.Random(11)
    rows, want = [], {}
    for cs in range(40):
        items = []
        for pos in range(rnd.randint(0, 12)):
            n = rnd.choice([10, 499, 500, 800, 2500])
            items.append((f"c{cs}/f{pos}", "x" * n))
            rows.append((f"c{cs}", pos, f"c{cs}/f{pos}", "x" * n))
        if items:
            want[f"c{cs}"] = _sequential([(p, d if len(d) <= 2000 else d[:2000] +
                                            "\n... (truncated for brevity)") for p, d in items])
    df = spark.createDataFrame(rows, "change_set string, pos bigint, path string, diff string")
    got = {}
    for r in SM.size_batches(df, limit=2000).collect():
        got.setdefault(r.change_set, []).append((r.batch_no, [m.path for m in r.members]))
    for cs, batches in want.items():
        assert [m for _, m in sorted(got[cs])] == batches, cs
        assert sorted(b for b, _ in got[cs]) == list(range(1, len(batches) + 1))


def test_distributed_row_number(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    rnd = random.Random(2)
    rows = [(rnd.choice("abc"), i) for i in rnd.sample(range(100000), 3000)]
    df = spark.createDataFrame(rows, "k string, o bigint")
    a = SM.distributed_row_number(df, ["k"], "o", "rn")
    b = df.withColumn("rn2", F.row_number().over(Window.partitionBy("k").orderBy("o")))
    j = a.join(b, ["k", "o"])
    assert j.where("rn <> rn2").count() == 0 and j.count() == 3000


def test_map_batches_errors_and_fold(spark):
    df = spark.createDataFrame([("c", 1, "a.py", "small a"), ("c", 2, "b.py", "x" * 600), ("c", 3, "c.py", "small c"),
                                ("d", 1, "z.py", "boom")], "change_set string, pos bigint, path string, diff string")

    def fn(prompt):
        if "boom" in prompt:
            raise RuntimeError("model down")
        return "  summary of " + prompt.split("\n")[0][:6] + "  "

    batches = SM.size_batches(df)
    res = SM.map_batches(batches, fn, template="{diff}")
    got = {(r.change_set, r.batch_no): (r.files, r.summary, r.error) for r in res.collect()}
    assert got[("c", 1)] == (["b.py"], "summary of xxxxxx", None)
    assert got[("c", 2)] == (["a.py", "c.py"], "summary of File:", None)   # stripped
    assert got[("d", 1)] == (["z.py"], None, "model down")
    folded = {r.change_set: r.summaries for r in SM.fold_summaries(res, change_sets=df).collect()}
    assert folded["c"] == "- b.py: summary of xxxxxx\n- a.py, c.py: summary of File:"
    assert folded["d"] is None
    failed, counts = SM.error_report(res)
    assert [(r.change_set, r.error) for r in failed.collect()] == [("d", "model down")]


def test_multi_item_prompt_format(spark):
    df = spark.createDataFrame([("c", 1, "a.py", "da"), ("c", 2, "b.py", "db")],
                               "change_set string, pos bigint, path string, diff string")
    b = SM.size_batches(df).select(SM.batch_prompt("P:{diff}").alias("p")).collect()[0].p
    assert b == "P:File: a.py\nda\n---\nFile: b.py\ndb"


def test_summarize_change_sets_chain(spark):
    df = spark.createDataFrame([("c", 1, "a.py", "add feature"), ("e", 1, "z.py", "boom")],
                               "change_set string, pos bigint, path string, diff string")

    def fn(prompt):
        if "boom" in prompt:
            raise RuntimeError("x")
        return SM.first_words(prompt, 2)

    def coord(prompt):
        return "```text\n" + prompt.split("\n")[-1] + "\n```"

    out = {r.change_set: (r.message, r.n_batches, r.n_failed)
           for r in SM.summarize_change_sets(df, fn, coord, file_prompt="{diff}").collect()}
    assert out["e"] == (None, 1, 1)
    assert out["c"] == ("- a.py: add feature", 1, 0)


def test_size_batches_keeps_null_rows_and_whole_texts(spark):
    rows = [("c", 1, "a", None), ("c", 2, "b", "x" * 5000), (None, 1, "n1", "y"), (None, 2, "n2", None), ("c", 10**12, "z", "s")]
    df = spark.createDataFrame(rows, "change_set string, pos bigint, path string, diff string")
    got = {(r.change_set, r.batch_no): [(m.path, m.diff) for m in r.members] for r in SM.size_batches(df).collect()}
    assert got == {("c", 1): [("b", "x" * 5000)], ("c", 2): [("a", ""), ("z", "s")], (None, 1): [("n1", "y"), ("n2", "")]}


def test_null_change_set_through_the_whole_chain(spark):
    rows = [(None, 1, "n1.py", "first part"), (None, 2, "n2.py", "x" * 600), (None, 3, "n3.py", "boom" * 200), ("c", 1, "a.py", "add feature")]
    df = spark.createDataFrame(rows, "change_set string, pos bigint, path string, diff string")

    def fn(prompt):
        if "boom" in prompt:
            raise RuntimeError("x")
        return prompt[:4]

    results = SM.map_batches(SM.size_batches(df), fn, template="{diff}")
    folded = {r.change_set: r.summaries for r in SM.fold_summaries(results, change_sets=df).collect()}
    assert folded == {None: "- n2.py: xxxx\n- n1.py: firs", "c": "- a.py: add"}
    out = SM.summarize_change_sets(df, fn, lambda p: p, file_prompt="{diff}", coordinator_prompt="{summaries}").collect()
    assert {r.change_set: (r.message, r.n_batches, r.n_failed, r.error) for r in out} == {
        None: ("- n2.py: xxxx\n- n1.py: firs", 3, 1, None), "c": ("- a.py: add", 1, 0, None)}
