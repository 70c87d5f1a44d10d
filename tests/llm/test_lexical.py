"""Operator 13 against SQL, a scan of all documents and fixtures of odd rows."""

import math
import random
import re
from collections import Counter

import pytest

from repolens.llm import ORACLE, QUERIES, lexical
from tests.conftest import SF_SMALL
from tests.oracle import compare


def _brute(docs, items, k=20):
    words = lambda t: [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    held = [(d, Counter(words(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n_docs, n_words = len(held), sum(sum(c.values()) for _, c in held)
    df, out = Counter(t for _, c in held for t in c), []
    for item, text in items:
        scored = []
        for d, c in held:
            m = 75 + (25 * sum(c.values()) * n_docs) // n_words
            s = sum(n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t, n in Counter(words(text)).items() if c[t])
            if s > 0:
                scored.append((-s, d is None, d))
        out += [(item, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def _got(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("code", lexical.F.lit("clash")).repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("item", lexical.F.lit("clash"))
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in lexical.search(d, i, **kw).collect()), key=str)


def test_query_matches_oracle(spark):
    r = compare(QUERIES["op13_lexical_search"](spark, SF_SMALL), ORACLE["op13_lexical_search"], SF_SMALL)
    assert r["match"], r


@pytest.mark.parametrize("segment,short,block,seeds", [(8192, 32, 64, 16), (40, 4, 3, 2), (7, 2, 2, 3)])
def test_equals_scoring_all_documents(spark, monkeypatch, segment, short, block, seeds):
    for name, x in (("SEGMENT_DOCS", segment), ("SHORT", short), ("BLOCK", block), ("SEEDS_ONE_IN", seeds)):
        monkeypatch.setattr(lexical, name, x)
    random.seed(segment)
    word = lambda: "w%d" % int(random.paretovariate(0.5))
    docs = [(i, " ".join(word() for _ in range(random.randint(0, 60)))) for i in range(300)]
    docs += [(400 + i, docs[3][1]) for i in range(100)] + [(None, docs[5][1]), (7, docs[7][1])]
    items = [(i, " ".join(word() for _ in range(random.randint(0, 30)))) for i in range(20)] + [(30, docs[3][1]), (30, docs[3][1]), (31, "nothing here"), (32, None)]
    assert _got(spark, docs, items) == _brute(docs, items)
    monkeypatch.setattr(lexical, "QUERY_TERMS", 60)  # several blocks of items
    assert _got(spark, docs, items, k=3) == _brute(docs, items, 3)


def test_blocks_are_skipped():
    """A query opens few of the documents that hold its common term."""
    import numpy as np

    rng = np.random.default_rng(5)
    rows = [np.unique(np.concatenate([[0], 1 + 20 * (d % 50) + rng.integers(0, 20, 8)])).astype(np.int32) for d in range(2000)]
    rows += [np.array([2000], np.int32)] * 7000
    weight = np.full(2001, 100, np.int64)
    batch = lexical.build_segment(list(range(9000)), rows, [np.full(len(r), 1000, np.int32) for r in rows], weight)
    segment, query = lexical.Segment(batch, 0), np.zeros(2001, np.int64)
    held = [0, 41, 42, 43, 44, 45]
    query[held] = 100
    ids, scores, opened = segment.search(query, held, 0, 20)
    every = sorted(((-int(query[r].sum()) * 1000, d) for d, r in enumerate(rows)))[:20]
    assert [(-int(s), int(d)) for d, s in zip(ids, scores)] == every and opened < 400


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, ".,;"), (4, "Ünï Code ÜNï"), (5, "a" * 5000), (6, "word " * 50_000), (7, "code"), (7, "code"), (None, "code")]
    items = [(1, "code ünï Ünï"), (2, None), (3, ""), (None, "word word CODE"), (5, "a" * 5000)]
    assert _got(spark, docs, items) == _brute(docs, items)
    assert _got(spark, docs, items[1:3]) == [] and _got(spark, docs[:3], items) == []
    assert _got(spark, [], items) == [] and _got(spark, docs, []) == []
