"""J8 on nested JSON layers against a recursive merge."""

import copy
import json
import random

from repolens.operators import nested as N


def _merge(base, update):
    for k, v in update.items():
        if isinstance(v, dict) and isinstance(base.get(k), dict):
            _merge(base[k], v)
        else:
            base[k] = copy.deepcopy(v)


def _leaves(d, at=""):
    for k, v in d.items():
        path = at + k.replace("%", "%25").replace(".", "%2E")
        if isinstance(v, dict) and v:
            yield from _leaves(v, path + ".")
        else:
            yield path, json.dumps(v, separators=(",", ":"), ensure_ascii=False)


def _tree(rnd, depth):
    def value():
        if depth and rnd.random() < 0.6:
            return _tree(rnd, depth - 1)
        return rnd.choice([1, -2.5, "s", "é", True, None, {}, [], [1, {"q": {}}]])
    return {k: value() for k in rnd.sample(["a", "b", "a.b", "%", "%2E", "Ab"], rnd.randint(0, 4))}


def test_merge_equals_recursive_merge(spark):
    rnd, rows, want = random.Random(3), [], []
    for stack in [*range(120), None]:
        merged = {}
        for layer in range(rnd.randint(1, 5)):
            tree = _tree(rnd, 4)
            rows.append((stack, layer, json.dumps(tree)))
            _merge(merged, tree)
        want += [(stack, k, v) for k, v in _leaves(merged)]
    df = spark.createDataFrame(rows, "stack int, priority int, settings string").repartition(5)
    got = [(r["stack"], r["key_path"], r["value"]) for r in N.merge_nested(df, ["stack"]).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_faulty_and_empty_layers(spark):
    deep = "{\"k\":" * 60 + "1" + "}" * 60
    df = spark.createDataFrame([(0, '{"a":{"b":1}}'), (1, "not json"), (2, "[1]"), (3, None), (4, " "), (5, "null"), (6, '{"a":1,"a":2}'),
                                (7, "{}"), (8, '{"a":{}}'), (9, deep), (None, '{"a":0,"z":0}')], "priority int, settings string")
    assert sorted(r[0] for r in N.invalid_layers(df).collect()) == [1, 2, 6]
    got = sorted((r["key_path"], r["value"], r["priority"]) for r in N.merge_nested(df).collect())
    assert got == [("a.b", "1", 0), (".".join("k" * 60), "1", 9), ("z", "0", None)]
    assert N.merge_nested(df.limit(0)).count() == 0
