"""Operator 11 against SQL, a plain count of all phrases and fixtures of odd rows."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from repolens.llm import ORACLE, QUERIES, collocations
from tests.conftest import SF_SMALL
from tests.oracle import compare


def _brute(rows, least=30, top=2000):
    f, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(ws)
            for k in range(1, 5):
                f[lang or "und"].update(tuple(ws[i:i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, n in f.items():
        cand = {p: a for p, a in n.items() if len(p) > 1 and a >= least}
        drop = {q for p, a in cand.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and (q := p[i:j]) in cand and 100 * a >= 80 * cand[q]}
        scored = []
        for p, a in cand.items():
            if p not in drop:
                s, _, l, r = min((2000000 * a // (n[p[:k]] + n[p[k:]]), k, n[p[:k]], n[p[k:]]) for k in range(1, len(p)))
                scored.append((-s, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def _got(spark, rows, **kw):
    docs = spark.createDataFrame([(lang, text, 1) for lang, text in rows], "lang string, text string, n long").repartition(3)
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in collocations.mine(docs, **kw).collect())


def _texts(seed):
    random.seed(seed)
    pick = lambda: random.choice(["new", "york", "The", "of", "é", "x\x00y", "w%d" % int(random.paretovariate(0.6))])
    bits = ["new york city", "in the state of play", "a b a b a b a"]
    return [(random.choice(["en", "en", None, "de"]), "".join((random.choice(bits) if random.random() < 0.3 else pick()) + random.choice(["  ", " ", " ", ". ", ",", "\t", "\n", "\x0b"])
                                                              for _ in range(random.randint(0, 120)))) for _ in range(150)]


def test_query_matches_oracle(spark):
    r = compare(QUERIES["op11_collocations"](spark, SF_SMALL), ORACLE["op11_collocations"], SF_SMALL)
    assert r["match"], r


@pytest.mark.parametrize("change", [{}, {"MAX_WORDS": 0, "MAX_PHRASES": 0}, {"TILE_BITS": 2, "PAIRS": 50, "WORDS": 20}])
def test_equals_a_plain_count(spark, monkeypatch, change):
    """Also in the joined form, and with small tiles and stretches."""
    for name, x in change.items():
        monkeypatch.setattr(collocations, name, x)
    rows = _texts(len(change))
    got = _got(spark, rows, least=5, top=60)
    assert got == _brute(rows, 5, 60) and len({r[0] for r in got}) == 3


def test_tiles_count_as_a_counter(monkeypatch):
    monkeypatch.setattr(collocations, "TILE_BITS", 3)
    rng = np.random.default_rng(2)
    left, right = np.minimum(rng.geometric(0.1, 5000), 40), np.minimum(rng.geometric(0.03, 5000), 200)
    got = {(a, b): n for a, b, n in zip(*(x.tolist() for x in collocations.tile_counts(left, right)))}
    assert got == Counter(zip(left.tolist(), right.tolist()))
    assert all(len(x) == 0 for x in collocations.tile_counts(left[:0], right[:0]))


def test_odd_rows(spark):
    rows = [("en", None), (None, ""), ("en", " \t. "), ("en", "one two " * 40_000), ("en", "Ab  cd. ab cd")] + [(None, "ab cd ef")] * 30
    assert _got(spark, rows) == _brute(rows)
    assert _got(spark, rows[:3]) == [] and _got(spark, []) == []
