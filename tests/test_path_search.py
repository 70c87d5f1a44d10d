"""Substring search by rarest grams against a plain scan."""

import random

from repolens.operators import sessions as S


def _frames(spark, paths, queries):
    return spark.createDataFrame([(p,) for p in paths], "path string"), spark.createDataFrame([(q,) for q in queries], "query string")


def test_search_equals_a_plain_scan(spark):
    rnd = random.Random(5)
    paths = ["/".join("".join(rnd.choice("abC.") for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(1, 4))) for _ in range(300)]
    paths += ["", "a", "ab", paths[0], "ärö/ß.py", None]
    queries = ["", "a", "B", "ab", "abc", "c/a", "abca", "a/b/c", "zzz", "abzzz", "ÄR", "ß.", "AB", ".py", None]
    got = {}
    for r in S.path_search(*_frames(spark, paths, queries), 7).collect():
        got.setdefault(r["query"], []).append((r["rank"], r["option"]))
    want = {}
    for q in {q.lower() for q in queries if q is not None}:
        hits = sorted({p for p in paths if p is not None and q in p.lower()}, key=lambda p: (p.count("/") + 1, p.lower(), p))[:7]
        if hits:
            want[q] = [(i + 1, "@" + p) for i, p in enumerate(hits)]
    assert {q: sorted(v) for q, v in got.items()} == want


def test_a_gram_of_all_paths_joins_only_without_another(spark):
    files, queries = _frames(spark, [f"src/m{i:03d}.py" for i in range(200)], ["src/m007", "src", "r", "src/nope", ".py"])
    f = files.selectExpr("lower(path) AS low")
    lengths = S._gram_lengths(queries)
    assert lengths == [1, 3]
    best = {r["query"]: (r["gram"], r["n"]) for r in S.rarest_grams(f, queries, lengths).collect()}
    assert best["src"] == ("src", 200) and best["r"] == ("r", 200) and best[".py"] == (".py", 200) and "src/nope" not in best
    assert best["src/m007"] == ("007", 1)
