"""Connected components by contraction, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, store


def components(edges: DataFrame, *, release: bool = False) -> DataFrame:
    """``node, component`` (the smallest reachable node) for the nodes of edges ``a, b`` (long).

    Each round every node takes its smallest neighbour's label, labels jump to their label's label,
    and edges are rewritten between labels; those inside one label vanish, so a star takes one
    round and a path of n nodes about log n.  Neighbours are only ever reduced by ``min``.  Edges
    with a null end and loops give no row; repeated edges count once.  ``release`` is that of ``store``.
    """
    spark = edges.sparkSession
    e, path = store(edges.select("a", "b").where("a <> b").distinct(), "edges", release=release)
    labels, held = None, []
    while True:
        paths = [path]
        if e.isEmpty():
            break
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("to"))
        low, low_path = store(low, "labels", release=release)
        up = low.select(F.col("node").alias("to"), F.col("to").alias("top"))
        step, step_path = store(low.join(up, "to").select("node", "top"), "labels", release=release)
        remove(spark, low_path)
        if labels is None:
            labels = step.select("node", F.col("top").alias("component"))
            held = [step_path]
        else:
            moved = labels.join(step.select(F.col("node").alias("component"), "top"), "component", "left").select("node", F.coalesce("top", "component").alias("component"))
            labels, new = store(moved, "labels", release=release)
            remove(spark, *held)
            held = [new]
            paths.append(step_path)
        of = lambda c: step.select(F.col("node").alias(c), F.col("top").alias(f"{c}_top"))
        left = e.join(of("a"), "a").join(of("b"), "b").where("a_top <> b_top")
        e, path = store(left.select(F.least("a_top", "b_top").alias("a"), F.greatest("a_top", "b_top").alias("b")).distinct(), "edges", release=release)
        remove(spark, *paths)
    remove(spark, path)
    if labels is None:
        return spark.createDataFrame([], "node long, component long")
    return labels
