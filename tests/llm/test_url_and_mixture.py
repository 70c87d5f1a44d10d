"""Operators 1 and 4: oracle on the small tables, edge cases on fixtures."""

from pyspark.sql import functions as F

from repolens.llm import ORACLE, QUERIES, common, mixture, url_rules
from tests.conftest import SF_SMALL
from tests.oracle import compare

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("WWW.example.com", "/en/", "allow"), ("net", "/e", "block"),
         ("net", "/e", "allow"), ("org", "", "block"), (None, "/", "block")]


def _rules(spark):
    return spark.createDataFrame(RULES, "host string, path string, verdict string")


def test_queries_match_oracle(spark):
    for name in ("op1_url_filter", "op4_mix_sources"):
        r = compare(QUERIES[name](spark, SF_SMALL), ORACLE[name], SF_SMALL)
        assert r["match"], r


def test_url_cases_and_paths_agree(spark, monkeypatch):
    urls = ["http://WWW.Example.com/en/1?q", "http://a.b.example.com/en/x#y", "http://example.com/en", "http://example.com", "http://x.net/eng/1",
            "http://net/es", "http://notexample.com/en/", "http://x.org", "http://x.org.", "no scheme", "", None, "://", "http://?q=/en/",
            "http://" + ".".join("a" * 3000) + ".com/" + "/".join("b" * 3000), "http://x.net/eng/1"]
    pages = spark.createDataFrame([(i % 14, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, rule string, host string")

    def brute(u):
        if u is None or "://" not in u:
            return "", "", None, "allow"
        rest = u.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]
        fits = [(len(h + p), len(h), v == "block", h.lower() + p, v) for h, p, v in RULES
                if h and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
        return (host, path, *max(fits)[3:]) if fits else (host, path, None, "allow")
    want = sorted(((i % 14, *brute(u)) for i, u in enumerate(urls)), key=repr)
    for rows in (common.BROADCAST_ROWS, -1):
        monkeypatch.setattr(url_rules, "BROADCAST_ROWS", rows)
        got = sorted((tuple(r) for r in url_rules.judge_urls(pages, _rules(spark)).collect()), key=repr)
        assert got == want
    assert url_rules.judge_urls(pages.limit(0), _rules(spark)).count() == 0
    none = url_rules.judge_urls(pages, _rules(spark).limit(0))
    assert none.where("rule is null and verdict = 'allow'").count() == len(urls)


def test_mixture_cases(spark):
    rows = [(i, "w " * (1 + i % 7), "hot" if i % 3 else f"s{i % 5}", "clash") for i in range(600)]
    rows += [(600, None, "s1", ""), (601, "a b", None, ""), (None, "a b c", None, ""), (5, rows[5][1], rows[5][2], ""), (602, " \n ", "blank", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target string")
    thin, sources = mixture.plan_mixture(docs, mixture.cyclic_weights)
    out = mixture.take(thin, sources).collect()
    assert len(out) == len(rows)
    total = sum(r["size"] for r in out)
    by = {}
    for r in out:
        s = by.setdefault(r["source"], [r["source_size"], r["target"], 0, 0])
        s[2] += r["taken"]
        s[3] = max(s[3], r["size"])
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert abs(sum(s[1] for s in by.values()) - 1.5 * total) < 1e-6 * total
    for size, target, taken, largest in by.values():
        assert target <= 2 * size + 1e-9 and abs(taken - target) <= largest
    again = mixture.take(*mixture.plan_mixture(docs.repartition(7), mixture.cyclic_weights))
    assert sorted(map(str, again.drop("hash").collect())) == sorted(map(str, mixture.take(thin, sources).drop("hash").collect()))
    mixed = mixture.mix_rows(docs, mixture.cyclic_weights)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in out)
    assert mixture.mix_rows(docs.limit(0), mixture.cyclic_weights).count() == 0
    odd = docs.selectExpr("doc_id", "text", "source", "doc_id AS base", "'x' AS cut", "1 AS hash", "2 AS `of`", "3 AS __n", "4 AS row", "5 AS `a.b`")
    assert sorted(map(str, mixture.mix_rows(odd, mixture.cyclic_weights).select("doc_id", "base", "cut", "__n").collect())) == \
        sorted(str(r) for r in mixed.selectExpr("doc_id", "doc_id AS base", "'x' AS cut", "3 AS __n").collect())


def test_targets_reshare_until_none_is_above(spark):
    s = spark.createDataFrame([("a", 10, 5.0), ("b", 100, 2.0), ("c", 1000, 1.0)], "source string, source_size long, weight double")
    got = {r["source"]: r["target"] for r in mixture.source_targets(s, 1.5, 2).collect()}
    assert got == {"a": 20.0, "b": 200.0, "c": 1445.0}
    got = {r["source"]: r["target"] for r in mixture.source_targets(s, 5, 2).collect()}
    assert got == {"a": 20.0, "b": 200.0, "c": 2000.0}
    assert [r["target"] for r in mixture.source_targets(s.withColumn("source_size", F.lit(0).cast("long")), 1.5, 2).collect()] == [0.0] * 3
