"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import write_table


def components(edges: DataFrame) -> DataFrame:
    """(u, v) -> (vertex, component), the smallest vertex reachable.

    Every round each vertex takes the smallest vertex next to it as its label,
    the label's label replaces it, and edges are contracted to labels; rounds
    go on until no edge is left.  Each round is written to the shared folder.
    """
    loose = edges.where(F.col("u") != F.col("v"))
    now = write_table(loose.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "cc-edges")
    whole = write_table(now.select(F.col("u").alias("vertex")).union(now.select("v")).distinct().withColumn("component", F.col("vertex")), "cc-labels")
    while now.limit(1).count():
        both = now.union(now.select("v", "u"))
        label = write_table(both.groupBy(F.col("u").alias("x")).agg(F.least(F.col("x"), F.min("v")).alias("l")), "cc-step")
        # Labels only decrease, so the label of a label is nearer to the end.
        jump = write_table(label.join(label.select(F.col("x").alias("y"), F.col("l").alias("ll")), F.col("l") == F.col("y"))
                           .select("x", F.col("ll").alias("l")), "cc-jump")
        whole = write_table(whole.join(jump, F.col("component") == F.col("x"), "left")
                            .select("vertex", F.coalesce("l", "component").alias("component")), "cc-labels")
        at_v = jump.select(F.col("x").alias("y"), F.col("l").alias("lv"))
        joined = now.join(jump, F.col("u") == F.col("x")).join(at_v, F.col("v") == F.col("y")).where(F.col("l") != F.col("lv"))
        now = write_table(joined.select(F.least("l", "lv").alias("u"), F.greatest("l", "lv").alias("v")).distinct(), "cc-edges")
    return whole
