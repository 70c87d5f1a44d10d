"""Layered settings in long form.

A settings layer is a set of leaf rows ``(layer, key_path, value)`` where
``key_path`` is a dot path into a nested mapping.  Merging, lookups and
redaction are equi joins on exploded key prefixes -- never a ``LIKE``
self-join -- so they scale with the number of keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions._util import col
from ..functions.text import py_strip

# Fixed values that must equal the reference's behaviour.
# Secret leaves removed from settings files: providers.<name>.api_key
SECRET_KEY_PATTERN = r"^providers\.[^.]+\.api_key$"


def proper_prefixes(key_path) -> Column:
    """``a.b.c`` -> ``[a, a.b]`` (empty for a single component)."""
    parts = F.split(col(key_path), r"\.")
    n = F.size(parts)
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(parts, 1, i), "."))) \
        .otherwise(F.array().cast("array<string>"))


def layered_overrides(layers: DataFrame, layer_col: str = "priority", key_col: str = "key_path",
                      value_col: str = "value") -> DataFrame:
    """Deep merge of layers applied in ascending ``layer_col`` order
    (the last layer wins).  A leaf ``(i, k)`` survives iff no later layer has
    (a) the same key, (b) a leaf at a proper prefix of ``k`` (a scalar that
    replaces the subtree) or (c) any key below ``k`` (a subtree that replaces
    the scalar).  Output: the merged leaves with the layer they come from.
    """
    L = layers.select(F.col(layer_col).alias("layer"), F.col(key_col).alias("key"), F.col(value_col).alias("value"))
    by_key = L.groupBy("key").agg(F.max("layer").alias("last_same"))
    # (c) for every key that has keys below it: the last layer holding one.
    below = (L.select("layer", F.explode(proper_prefixes("key")).alias("key"))
             .groupBy("key").agg(F.max("layer").alias("last_below")))
    # (b) for every leaf: the last layer with a leaf at one of its prefixes.
    pref = (L.select("layer", "key", F.explode(proper_prefixes("key")).alias("prefix"))
            .join(by_key.withColumnRenamed("key", "prefix"), "prefix")
            .groupBy("layer", "key").agg(F.max("last_same").alias("last_prefix")))
    j = L.join(by_key, "key", "left").join(below, "key", "left").join(pref, ["layer", "key"], "left")
    later = F.greatest(F.col("last_same"), F.col("last_below"), F.col("last_prefix"))
    out = j.where(later.isNull() | (later <= F.col("layer")))
    return out.select(F.col("layer").alias(layer_col), F.col("key").alias(key_col), F.col("value").alias(value_col))


def redact_settings(layers: DataFrame, key_col: str = "key_path", pattern: str = SECRET_KEY_PATTERN,
                    layer_col: str = "priority", only_layers=None) -> tuple[DataFrame, DataFrame]:
    """Drop secret leaves (``pattern``) from the given layers (default
    all) and report, per layer, how many were dropped.  Returns
    ``(kept, report)``."""
    secret = F.col(key_col).rlike(pattern)
    if only_layers is not None:
        secret = secret & F.col(layer_col).isin(*list(only_layers))
    flagged = layers.withColumn("_secret", secret)
    kept = flagged.where(~F.col("_secret")).drop("_secret")
    report = (flagged.where("_secret").groupBy(layer_col).agg(F.count("*").alias("n_removed")))
    return kept, report


def lookup_by_path(settings: DataFrame, requests: DataFrame, key_col: str = "key_path",
                   value_col: str = "value", default_col: str = "default") -> DataFrame:
    """Per requested dot path: the leaf value when the path is a leaf
    (a present null stays null), ``found`` and ``is_subtree`` flags when it
    names an inner node, else the request's default."""
    leaf = settings.select(F.col(key_col).alias("key_path"), F.col(value_col).cast("string").alias("_v"),
                           F.lit(True).alias("_leaf"))
    inner = (settings.select(F.explode(proper_prefixes(key_col)).alias("key_path")).distinct()
             .withColumn("_inner", F.lit(True)))
    r = requests.select(F.col("key_path"), F.col(default_col).cast("string").alias("_d"))
    j = r.join(leaf, "key_path", "left").join(inner, "key_path", "left")
    is_leaf = F.coalesce(F.col("_leaf"), F.lit(False))
    is_inner = F.coalesce(F.col("_inner"), F.lit(False))
    value = F.when(is_leaf, F.col("_v")).when(is_inner, F.lit(None).cast("string")).otherwise(F.col("_d"))
    return j.select("key_path", value.alias("value"), (is_leaf | is_inner).alias("found"),
                    (~is_leaf & is_inner).alias("is_subtree"))


_INT = r"^[+-]?[0-9](_?[0-9])*$"
_FLOAT = r"^[+-]?(([0-9](_?[0-9])*)?\.[0-9](_?[0-9])*|[0-9](_?[0-9])*\.)([eE][+-]?[0-9](_?[0-9])*)?$"


def coerce_typed_value(value) -> dict[str, Column]:
    """``true``/``false`` (any case) -> bool; text with a ``.`` that
    Python's ``float`` accepts -> float; text ``int`` accepts -> int; else
    the string.  A numeric regex guards the casts (Spark would also accept
    ``1.5d`` or ``2f``).  ASCII digits only; Python also accepts other
    Unicode digits."""
    v = col(value)
    s = py_strip(v)
    low = F.lower(v)
    clean = F.regexp_replace(s, "_", "")
    is_bool = low.isin("true", "false")
    is_float = ~is_bool & F.contains(v, F.lit(".")) & s.rlike(_FLOAT)
    is_int = ~is_bool & ~F.contains(v, F.lit(".")) & s.rlike(_INT)
    kind = (F.when(v.isNull(), F.lit(None).cast("string")).when(is_bool, "bool").when(is_float, "float")
            .when(is_int, "int").otherwise("string"))
    return {
        "type": kind,
        "bool_value": F.when(is_bool, low == "true"),
        "int_value": F.when(is_int, clean.try_cast("bigint")),
        "float_value": F.when(is_float, clean.try_cast("double")),
        "str_value": F.when(~is_bool & ~is_float & ~is_int, v),
    }
