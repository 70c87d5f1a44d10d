"""Operator 12 against SQL, a dictionary model and fixtures of odd rows."""

import numpy as np
import pytest

from repolens.llm import ORACLE, QUERIES, exact
from tests.conftest import SF_SMALL
from tests.oracle import compare


def test_query_matches_oracle(spark):
    r = compare(QUERIES["op12_exact_dedup"](spark, SF_SMALL), ORACLE["op12_exact_dedup"], SF_SMALL)
    assert r["match"], r


def test_filter_follows_a_dictionary(monkeypatch):
    """Insertions, deletions, moves and growth against a plain count."""
    monkeypatch.setattr(exact, "MAX_MOVES", 5)
    rng = np.random.default_rng(1)
    one, model = exact.CuckooFilter(1), {}
    pool = rng.integers(-2 ** 63, 2 ** 63 - 1, 3000)
    for step in range(60):
        keys, n = exact._sums(rng.choice(pool, 200), np.ones(200, np.int64))
        if step % 3 < 2:
            one.insert(keys, n)
            for k, x in zip(keys.tolist(), n.tolist()):
                model[k] = model.get(k, 0) + x
        else:
            one.delete(keys, n)
            for k, x in zip(keys.tolist(), n.tolist()):
                if model.get(k, 0) - x > 0:
                    model[k] -= x
                else:
                    model.pop(k, None)
        at = one.find(pool)
        assert {int(k): int(one.live[a]) for k, a in zip(pool, at) if a >= 0} == model
        assert one.taken == len(model) == np.count_nonzero(one.fingerprint)
    assert one.buckets > 1


@pytest.mark.parametrize("keys", [1 << 20, 40])
def test_index_is_advanced(spark, monkeypatch, keys):
    """Stored parts go on; with few keys a part, they are dealt anew."""
    monkeypatch.setattr(exact, "PART_KEYS", keys)
    h = lambda a, b: spark.range(a, b).selectExpr("xxhash64(id % 500) AS h")
    live = lambda i: {r["h"]: r["live"] for r in i.collect()}
    a = exact.write_table(exact.advance(None, h(0, 600)), "t")
    b = exact.write_table(exact.advance(a, h(0, 400), h(100, 700)), "t")
    id_of = {r["h"]: r["i"] for r in spark.range(500).selectExpr("xxhash64(id) AS h", "id AS i").collect()}
    assert {id_of[k]: n for k, n in live(a).items()} == {i: 1 + (i < 100) for i in range(500)}
    want = {i: (1 + (i < 100)) + (i < 400) - ((100 <= i) + (i < 200)) for i in range(500)}
    assert {id_of[k]: n for k, n in live(b).items()} == {i: n for i, n in want.items() if n > 0}
    assert live(exact.advance(b, None, h(0, 5000))) == {}
    assert exact.advance(None, spark.range(0).selectExpr("id AS h")).count() == 0


def test_odd_rows(spark):
    rows = [(5, "a b", "x"), (3, "ab", "x"), (4, "a\u000bb", "x"), (1, "a  b", "x"), (2, None, "x"), (9, " \t", "x"), (7, "", "x"), (None, "ab ", "x"),
            (8, "é ", "x"), (8, "é ", "x"), (6, "w " * 90_000, "x"), (10, "w" * 90_000, "x"), (None, "null id", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h string").repartition(3)
    got = sorted(((r["doc_id"] or 0, r["keep_id"], r["group_size"], r["kept"]) for r in exact.find_copies(docs).collect()), key=str)
    want = sorted([(5, 1, 5, False), (3, 1, 5, False), (4, 1, 5, False), (1, 1, 5, True), (0, 1, 5, False), (2, 9, 3, False), (9, 9, 3, True), (7, 9, 3, False),
                   (8, 8, 2, True), (8, 8, 2, False), (6, 6, 2, True), (10, 6, 2, False), (0, None, 1, True)], key=str)
    assert got == want
    assert exact.find_copies(docs.limit(0)).count() == 0


def test_a_digest_of_two_texts_is_told_apart(spark, monkeypatch):
    """Texts that share the short digest are compared themselves."""
    monkeypatch.setattr(exact.F, "xxhash64", lambda c: exact.F.lit(7).cast("long"))
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a "), (4, "c")], "doc_id long, text string")
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact.find_copies(docs).collect()}
    assert got == {1: (3, 2), 2: (2, 1), 3: (3, 2), 4: (4, 1)}
