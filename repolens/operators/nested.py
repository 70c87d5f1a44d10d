"""Nested settings layers (J8): JSON documents merged key by key.

A layer is one JSON object of any depth.  ``flatten_layers`` opens objects as
VARIANT maps, one level a round and all layers at once, until no object is
left; ``merge_nested`` merges the leaves by equi joins on keys and exploded
key prefixes, never layer by layer.

A key path joins the keys with ``.``; inside a key ``%`` and ``.`` are written
``%25`` and ``%2E``, so a key with a dot is not taken for two levels.  Values
are JSON texts.  An array is a leaf: it replaces and is replaced whole.  An
empty object is a leaf ``{}`` that stands for a subtree: it replaces an earlier
scalar, keeps the earlier keys below its path and is gone when any key
below it is left.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .settings import proper_prefixes

_OBJECT = "map<string,variant>"


def _parsed(layers: DataFrame, by: list[str], layer_col: str, json_col: str) -> DataFrame:
    text = F.when(F.trim(F.col(json_col)) != "", F.col(json_col))
    return layers.select(*by, layer_col, text.alias("_text"), F.try_parse_json(text).alias("_v"))


def _is_null(v):
    return F.is_variant_null(v)


def invalid_layers(layers: DataFrame, by: list[str] | None = None, layer_col: str = "priority", json_col: str = "settings") -> DataFrame:
    """``by..., layer`` of the layers that are left out of a merge: no JSON, an
    object with a key twice, or neither an object nor ``null``.  A null or
    empty document is an empty layer, no fault."""
    p = _parsed(layers, by or [], layer_col, json_col)
    fault = F.col("_v").isNull() | (~_is_null("_v") & F.try_variant_get("_v", "$", _OBJECT).isNull())
    return p.where(F.col("_text").isNotNull() & fault).select(*(by or []), layer_col)


def flatten_layers(layers: DataFrame, by: list[str] | None = None, layer_col: str = "priority", json_col: str = "settings") -> DataFrame:
    """``by..., layer, key_path, value, is_empty``: one row for each leaf of each
    valid layer; ``is_empty`` marks empty objects (the top one has no row).
    Rounds: the greatest depth.  Each round's objects are written once, so a
    lost executor costs one round."""
    by = by or []
    opened = _parsed(layers, by, layer_col, json_col).select(
        *by, layer_col, F.lit(None).cast("string").alias("_at"), F.try_variant_get("_v", "$", _OBJECT).alias("_m")).where(F.col("_m").isNotNull())
    found = []
    while True:
        step = F.replace(F.replace("_key", F.lit("%"), F.lit("%25")), F.lit("."), F.lit("%2E"))
        inner = (opened.select(*by, layer_col, "_at", F.explode("_m").alias("_key", "_v"))
                 .select(*by, layer_col, F.concat(F.coalesce(F.concat("_at", F.lit(".")), F.lit("")), step).alias("_at"), "_v")
                 .withColumn("_m", F.when(~_is_null("_v"), F.try_variant_get("_v", "$", _OBJECT))))
        empty = F.coalesce(F.size("_m") == 0, F.lit(False))
        inner = inner.select(*by, layer_col, "_at", "_m", F.when(F.col("_m").isNull() | empty, F.to_json("_v")).alias("value"), empty.alias("is_empty"))
        inner = inner.checkpoint(eager=True)
        found.append(inner.where(F.col("value").isNotNull()).select(*by, layer_col, F.col("_at").alias("key_path"), "value", "is_empty"))
        opened = inner.where(F.col("value").isNull()).select(*by, layer_col, "_at", "_m")
        if opened.isEmpty():
            return reduce(DataFrame.unionAll, found)


def merge_nested(layers: DataFrame, by: list[str] | None = None, layer_col: str = "priority", json_col: str = "settings") -> DataFrame:
    """J8 on nested documents: the leaves of the deep merge of each stack
    (``by``; a null is a stack's value as any other) in ascending ``layer_col`` order, ``by..., layer, key_path,
    value`` with the layer a leaf comes from.  Layers of a stack must differ in
    ``layer_col``; a null layer comes first.

    A leaf is left iff no later layer has its key, a leaf (not ``{}``) at a
    proper prefix of it or, for a leaf other than ``{}``, any key below it."""
    by = by or []
    leaves = flatten_layers(layers, by, layer_col, json_col).checkpoint(eager=True)
    # A key of all stacks is one struct: equal structs are equal in their nulls.
    at = lambda path: F.struct(*by, F.col(path).alias("path"))
    layer = F.struct(F.col(layer_col).alias("n"))
    rows = leaves.select(at("key_path").alias("key"), layer.alias("layer"), "value", "is_empty")
    above = leaves.select(at("key_path").alias("key"), layer.alias("layer"), "is_empty", *by, F.explode(proper_prefixes("key_path")).alias("_up"))
    above = above.select("key", "layer", "is_empty", at("_up").alias("up"))
    by_key = rows.groupBy("key").agg(F.max("layer").alias("last_same"), F.max(F.when(~F.col("is_empty"), F.col("layer"))).alias("last_leaf"))
    below = above.groupBy(F.col("up").alias("key")).agg(F.max("layer").alias("last_below"))
    scalar_up = (above.join(by_key.select(F.col("key").alias("up"), "last_leaf").where(F.col("last_leaf").isNotNull()), "up")
                 .groupBy("key").agg(F.max("last_leaf").alias("last_up")))
    j = rows.join(by_key.drop("last_leaf"), "key").join(below, "key", "left").join(scalar_up, "key", "left")
    older = lambda c: F.col(c).isNull() | (F.col(c) <= F.col("layer"))
    left = j.where(older("last_same") & older("last_up") & (F.col("is_empty") | older("last_below"))).select("key", "layer", "value", "is_empty")
    left = left.checkpoint(eager=True)
    held = left.select("key.*", F.explode(proper_prefixes("key.path")).alias("_up")).select(at("_up").alias("key")).distinct()
    out = left.where(~F.col("is_empty")).unionByName(left.where("is_empty").join(held, "key", "left_anti"))
    return out.select(*[F.col(f"key.{c}").alias(c) for c in by], F.col("layer.n").alias(layer_col), F.col("key.path").alias("key_path"), "value")
