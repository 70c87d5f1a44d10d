"""Layered settings: merge, lookup, redaction, typed values."""

import copy
import random

from repolens.operators import settings as S


def _deep_merge(base, update):
    for k, v in update.items():
        if isinstance(v, dict) and k in base and isinstance(base[k], dict):
            _deep_merge(base[k], v)
        else:
            base[k] = copy.deepcopy(v)


def _leaves(d, prefix=""):
    for k, v in d.items():
        p = f"{prefix}{k}"
        if isinstance(v, dict):
            yield from _leaves(v, p + ".")
        else:
            yield p, v


def _random_tree(rnd, depth=0):
    out = {}
    for k in rnd.sample("abcd", rnd.randint(1, 3)):
        if depth < 2 and rnd.random() < 0.5:
            sub = _random_tree(rnd, depth + 1)
            if sub:
                out[k] = sub
        else:
            out[k] = rnd.randint(0, 99)
    return out


def test_layered_overrides_matches_sequential_merge(spark):
    rnd = random.Random(7)
    rows, expected = [], []
    for stack in range(60):
        layers = [_random_tree(rnd) for _ in range(rnd.randint(1, 4))]
        merged = {}
        for i, layer in enumerate(layers):
            _deep_merge(merged, layer)
            rows += [(stack, i, k, str(v)) for k, v in _leaves(layer)]
        expected += [(stack, k, str(v)) for k, v in _leaves(merged)]
    df = spark.createDataFrame(rows, "stack int, priority int, key_path string, value string")
    got = []
    for s in range(60):
        part = df.where(df.stack == s).drop("stack")
        got += [(s, r.key_path, r.value) for r in S.layered_overrides(part).collect()]
    assert sorted(got) == sorted(expected)


def test_file_overrides_default_and_env_wins(spark):
    layers = spark.createDataFrame([
        (0, "core.timeout", "30"), (0, "providers.openai.base_url", "https://api"),
        (1, "core.timeout", "99"), (1, "providers.openai.api_key", "BAD_KEY"),
        (1, "providers.openai.base_url", "https://custom.url"),
        (2, "providers.openai.api_key", "env-key")], "priority int, key_path string, value string")
    kept, report = S.redact_settings(layers, only_layers=[1])
    assert {r.priority: r.n_removed for r in report.collect()} == {1: 1}
    merged = {r.key_path: r.value for r in S.layered_overrides(kept).collect()}
    assert merged == {"core.timeout": "99", "providers.openai.base_url": "https://custom.url",
                      "providers.openai.api_key": "env-key"}


def test_lookup_by_path(spark):
    settings = spark.createDataFrame([("core.timeout", "99"), ("core.debug", None), ("agents.chat.model", "m")],
                                     "key_path string, value string")
    req = spark.createDataFrame([("core.timeout", "d"), ("core.debug", "d"), ("core", "d"), ("nope.x", "d"),
                                 ("agents.chat", "d")], "key_path string, default string")
    got = {r.key_path: (r.value, r.found, r.is_subtree) for r in S.lookup_by_path(settings, req).collect()}
    assert got["core.timeout"] == ("99", True, False)
    assert got["core.debug"] == (None, True, False)   # a present null stays null
    assert got["core"] == (None, True, True)
    assert got["nope.x"] == ("d", False, False)
    assert got["agents.chat"] == (None, True, True)


def _py_coerce(val):
    if val.lower() == "true":
        return "bool", True
    if val.lower() == "false":
        return "bool", False
    try:
        if "." in val:
            return "float", float(val)
        return "int", int(val)
    except ValueError:
        return "string", val


def test_coerce_typed_value_matches_python(spark):
    vals = ["100", "false", "TRUE", "1.50", "1.5d", "2f", "abc", " 42 ", "1_000", "-3.", ".5e1", "1.2.3", "+7",
            "", "0", "1e5", "inf", "nan.", "  -0.25  ", "1__0", "_1", "1.", "."]
    df = spark.createDataFrame([(v,) for v in vals], "value string")
    cols = S.coerce_typed_value("value")
    rows = df.select("value", *[c.alias(n) for n, c in cols.items()]).collect()
    for r in rows:
        kind, value = _py_coerce(r.value)
        assert r.type == kind, r.value
        got = {"bool": r.bool_value, "int": r.int_value, "float": r.float_value, "string": r.str_value}[kind]
        assert got == value, r.value
