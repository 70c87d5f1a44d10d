"""Operators 3, 6 and 9 against brute force, with limits lowered so that the
paths for large inputs run as well."""

import random

import numpy as np
from pyspark.sql import functions as F

from repolens.llm import QUERIES, jaccard, neighbours, substrings
from repolens.llm.components import components
from tests.conftest import SF_SMALL


def _texts(seed, n=120):
    """Originals, edited copies, exact copies, a passage many share, odd rows."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcde") for _ in range(5))
    passage, out = [word() for _ in range(60)], []
    for k in range(n):
        if k % 4 == 0 or not out:
            w = [word() for _ in range(rng.randint(1, 260))]
        else:
            w = list(rng.choice(out[:12]))
            for _ in range(rng.choice([0, 1, 2, 4, 8])):
                w[rng.randrange(len(w))] = word()
        if k % 5 == 0:
            at = rng.randrange(len(w) + 1)
            w[at:at] = passage[rng.randint(0, 9):]
        out.append(w)
    return [" ".join(w) for w in out] + [None, "", " \n ", "one two", "One TWO", passage[0], " ".join(passage), "é ü ß ñ ç " * 30]


def _docs(spark, texts):
    rows = [(i * 3, t, "clash") for i, t in enumerate(texts)] + [(None, texts[0], ""), (6, texts[2], ""), (9, "same id other text " * 20, "")]
    return spark.createDataFrame(rows, "doc_id long, text string, node string").repartition(5)


def _brute_components(rows):
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    sets = []
    for i, t in rows:
        w = (t or "").encode().translate(lower).split()
        sets.append((i, frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()))
    root = {i: i for i, s in sets}

    def find(x):
        return x if root[x] == x else find(root[x])
    for a, (i, s) in enumerate(sets):
        for j, u in sets[:a]:
            if i is not None and j is not None and s and u and 100 * len(s & u) >= 75 * len(s | u):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else find(i) if s else i) for i, s in sets), key=repr)


def test_jaccard_components_equal_brute_force(spark, monkeypatch):
    docs = _docs(spark, _texts(1))
    want = _brute_components([(r[0], r[1]) for r in docs.select("doc_id", "text").collect()])
    assert sorted((tuple(r) for r in jaccard.similar_components(docs).collect()), key=repr) == want
    assert len({c for _, _, c in want}) < len(want) - 20
    # Hot tokens, several blocks a family, no broadcasts, a frequency sample of all texts.
    for name, value in (("MAX_NODES", 3), ("BLOCK_NODES", 4), ("BROADCAST_TOKENS", 0), ("SAMPLE_ONE_IN", 1), ("FREQUENT", 5)):
        monkeypatch.setattr(jaccard, name, value)
    assert sorted((tuple(r) for r in jaccard.similar_components(docs).collect()), key=repr) == want
    assert jaccard.similar_components(docs.limit(0)).count() == 0


def _brute_links(rows):
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    sets = []
    for i, t in rows:
        w = (t or "").encode().translate(lower).split()
        sets.append((i, frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()))
    known = {(i, s) for i, s in sets if i is not None and s}
    return {(i, len(s)): None if i is None else sum(100 * len(s & u) >= 75 * len(s | u) for _, u in known) - 1 if s else 0 for i, s in sets}


def test_jaccard_number_of_links_equals_brute_force(spark, monkeypatch):
    docs = _docs(spark, _texts(1))
    rows = [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]
    want, components_ = _brute_links(rows), _brute_components(rows)
    assert max(x or 0 for x in want.values()) > 5
    # As they are; then several blocks a family and no broadcasts.
    for values in ({}, {"MAX_NODES": 3, "BLOCK_NODES": 4, "BROADCAST_TOKENS": 0, "SAMPLE_ONE_IN": 1, "FREQUENT": 5}):
        for name, value in values.items():
            monkeypatch.setattr(jaccard, name, value)
        got = jaccard.similar_components(docs, links=True).collect()
        assert sorted((tuple(r)[:3] for r in got), key=repr) == components_
        assert {(r.doc_id, r.n_shingles): r.n_links for r in got} == want
    assert jaccard.similar_components(docs.limit(0), links=True).count() == 0


def test_linked_pairs_in_blocks():
    rng = np.random.default_rng(2)
    base = np.unique(rng.integers(0, 1 << 60, 400).astype(np.uint64))
    sets = [np.unique(np.r_[rng.choice(base, rng.integers(300, len(base)), replace=False), rng.integers(0, 1 << 60, rng.integers(0, 40)).astype(np.uint64)])
            for _ in range(40)]
    want = {(i, j) for i in range(40) for j in range(i + 1, 40)
            if 100 * (k := len(np.intersect1d(sets[i], sets[j]))) >= 75 * (len(sets[i]) + len(sets[j]) - k)}
    assert set(jaccard._linked(sets, None)) == want and want
    across = {(i, j - 20) for i, j in want if i < 20 <= j}
    assert {(i, j - 20) for i, j in jaccard._linked(sets[:20], sets[20:])} == across


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 5), (7, 7), (60, 61), (62, 61), (3, 90), (91, 90)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {got[k] for k in [*range(41), 90, 91, 100]} == {0} and got[62] == 60 and 7 in got
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def _brute_kept(rows, size):
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - size + 1):
            key = tuple(w[k:k + size])
            if i is not None:
                first[key] = min(i, first.get(key, i))
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if i is not None and first[tuple(w[k:k + size])] < i:
                gone[k:k + size] = [True] * size
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return sorted(out, key=repr)


def test_substrings_equal_brute_force(spark):
    docs = _docs(spark, [*_texts(2), "a " * 300, "a " * 120, "b a " * 200])
    rows = [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]
    for size, anchor in ((50, 25), (12, 5), (3, 3)):
        got = substrings.remove_repeats(docs, size=size, anchor=anchor).select("doc_id", "n_words", "n_removed", "kept").collect()
        assert sorted((tuple(r) for r in got), key=repr) == _brute_kept(rows, size)
    spans = substrings.remove_repeats(docs).where("spans is not null").select("spans", "n_removed").collect()
    assert spans and all(sum(x["end"] - x["start"] for x in r["spans"]) == r["n_removed"] for r in spans)
    assert substrings.remove_repeats(docs.limit(0)).count() == 0


def test_substrings_repeated_within_the_document(spark):
    w = lambda tag, n: " ".join(f"{tag}{k}" for k in range(n))
    x, p, y, a, b = w("x", 40), w("p", 70), w("y", 40), w("a", 45), w("b", 45)
    rows = [(3, f"{x} {p} {y}"), (5, f"{a} {p} {b} {a} {p} {b}"), (7, f"{y} {p} {x}"), (7, f"{a} {p} {b} {w('z', 60)}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = substrings.remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept").collect()
    assert sorted((tuple(r) for r in got), key=repr) == _brute_kept(rows, 50)
    assert {r.n_removed for r in got if r.doc_id == 5} == {140}


def _removed_words(rows, size):
    """Words removed per id by a comparison of all windows, one hash each."""
    hashes, ids, spans = [], [], []
    for i, t in rows:
        words = (t or "").encode().split()
        line, ends = b" ".join(words), np.cumsum([len(x) + 1 for x in words])
        starts = np.r_[0, ends[:-1]] if words else ends
        n = max(len(words) - size + 1, 0)
        hashes.append(np.fromiter((hash(line[starts[k]:ends[k + size - 1] - 1]) for k in range(n)), np.int64, n))
        ids.append(np.full(n, i))
        spans.append((i, len(words), n))
    h, d = np.concatenate(hashes), np.concatenate(ids)
    order = np.lexsort((d, h))
    new = np.r_[True, h[order][1:] != h[order][:-1]]
    gone = np.empty(len(h), bool)
    gone[order] = d[order] > d[order][new][np.cumsum(new) - 1]
    out, at = [], 0
    for i, words, n in spans:
        edge = np.zeros(words + 1, np.int64)
        k = np.flatnonzero(gone[at:at + n])
        np.add.at(edge, k, 1)
        np.add.at(edge, k + size, -1)
        out.append((i, int((np.cumsum(edge)[:words] > 0).sum())))
        at += n
    return sorted(out)


def test_substrings_on_the_whole_large_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    want = _removed_words([(r[0], r[1]) for r in docs.collect()], 50)
    assert sorted((r[0], r[1]) for r in substrings.remove_repeats(docs).select("doc_id", "n_removed").collect()) == want


def test_substring_and_jaccard_queries_on_whole_table(spark):
    import hashlib

    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    want = [(i, n, g, hashlib.sha256(k.encode()).hexdigest()) for i, n, g, k in _brute_kept(rows, 50)]
    assert sorted(tuple(r) for r in QUERIES["op3_substring_dedup"](spark, SF_SMALL).collect()) == sorted(want)
    assert sorted((tuple(r) for r in QUERIES["op6_jaccard_join"](spark, SF_SMALL).collect()), key=repr) == _brute_components(rows)


def _brute_nearest(rows, k, step):
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], float)
    out = {}
    for i in np.flatnonzero(ids % step == 0):
        s = x @ x[i]
        order = [j for j in np.lexsort((ids, -np.round(s, 12))) if j != i][:k]
        out[int(ids[i])] = [int(ids[j]) for j in order]
    return out


def test_nearest_recall_scores_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    good = [(i, (centres[i % 12] * (1 + i % 3) + 0.3 * rng.normal(size=16)).astype(np.float32).tolist()) for i in range(1500)]
    good += [(i, good[7][1]) for i in range(1500, 2000)]  # one vector that many rows share
    odd = [(3000, None), (3020, []), (3040, [0.0] * 16), (3060, [float("nan")] + [1.0] * 15), (3080, [1.0, 2.0]), (3100, [None] + [1.0] * 15), (None, good[0][1]),
           (3120, [float("inf")] + [1.0] * 15), good[0]]
    df = spark.createDataFrame([(*r, "clash") for r in good + odd], "vec_id long, embedding array<float>, v string")
    out = neighbours.search(df, F.col("id") % 20 == 0, leaf_rows=64).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
        a, b = dict(good)[r["query_id"]], dict(good)[r["vec_id"]]
        assert abs(r["score"] - sum(x * y for x, y in zip(a, b))) < 1e-9
    want = _brute_nearest(good, 20, 20)
    assert set(got) == set(want) and all(len(v) == 20 and q not in v for q, v in got.items())
    hit = sum(len(set(got[q]) & set(want[q])) for q in want) / sum(map(len, want.values()))
    assert hit >= 0.9
    rows = sorted(out, key=lambda r: (r["query_id"], r["rank"]))
    for r, s in zip(rows, rows[1:]):
        assert r["query_id"] != s["query_id"] or (-r["score"], r["vec_id"]) < (-s["score"], s["vec_id"])
    assert any(r["score"] == s["score"] for r, s in zip(rows, rows[1:]))
    few = neighbours.search(df.where("vec_id < 5"), F.col("id") % 20 == 0).collect()
    assert [r["rank"] for r in sorted(few, key=lambda r: r["rank"])] == [1, 2, 3, 4]
    assert neighbours.search(df.limit(0), F.col("id") % 20 == 0).count() == 0
    assert neighbours.search(df.where("vec_id = 0").limit(1), F.col("id") % 20 == 0).count() == 0


def test_nearest_query_recall(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = {}
    for r in QUERIES["op9_nearest"](spark, sf).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = _brute_nearest(rows, 20, 20)
    assert sum(len(got[q] & set(want[q])) for q in want) >= 0.9 * sum(map(len, want.values()))


def test_jaccard_worker_gives_memory_back():
    """What a batch took does not stay with a worker: in a process of its own,
    Arrow's freed buffers are gone when a batch of nodes was compared."""
    import os
    import subprocess
    import sys

    code = """
import re
import pyarrow as pa
from repolens.llm import jaccard as J, words as W

def held():
    with open("/proc/self/smaps_rollup") as f:
        return int(re.search(r"Anonymous: +([0-9]+)", f.read())[1]) / 1024

texts = [" ".join(f"a{k}b{i}" for i in range(200)) for k in range(20)]
node = lambda t: J.xxhash.xxh3_64_intdigest(J.shingle_set(t).tobytes()) - (1 << 63)
n = len(texts)
cols = [[1] * n, [0] * n, [0] * n, [0] * n, list(range(n)), [node(t) for t in texts], texts, [1] * n]
batch = pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["family", "i", "j", "side", "rep", "node", "text", "size"])
list(J._open(iter([batch])))
before = held()
many = [pa.array(["x" * 100_000]) for _ in range(2_000)]
assert held() - before > 150
del many[::2]
del many
list(J._open(iter([batch])))
assert held() - before < 40, held() - before
"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
