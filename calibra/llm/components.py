"""Connected components of a link table, as DataFrames (nothing is collected)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibra.llm.scratch import saved


def components(links: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node reachable over `links` (u, v).

    Rounds of hooking and contraction: every node points to its smallest neighbour if that
    is smaller, pointers are doubled until they reach roots, and links between different
    roots make the next, smaller graph.  The minimum per node is a partial-then-final
    aggregate.  Pointer joins look up a saved table with one row per node, so Spark can
    split the side that holds a popular root.  Null ends are ignored.
    """
    spark = links.sparkSession
    edges = saved(links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
                  .where("u < v").distinct(), "edges")
    labels = spark.createDataFrame([], "node long, root long")
    while edges.limit(1).count():
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        pointer = saved(both.groupBy("u").agg(F.min("v").alias("m"))
                        .select(F.col("u").alias("node"), F.least("u", "m").alias("root")), "pointer")
        while True:
            onward = pointer.select(F.col("node").alias("root"), F.col("root").alias("next"))
            doubled = saved(pointer.join(onward, "root").select("node", F.col("next").alias("root"),
                                                                (F.col("next") != F.col("root")).alias("moved")), "pointer")
            moved = doubled.where("moved").limit(1).count()
            pointer = doubled.select("node", "root")
            if not moved:
                break
        step = pointer.select(F.col("node").alias("was"), F.col("root").alias("now"))
        older = labels.join(step, F.col("root") == F.col("was"), "left").select(
            "node", F.coalesce("now", "root").alias("root"))
        newer = pointer.join(labels.select("node"), "node", "left_anti")
        labels = saved(older.unionByName(newer), "labels")
        left, right = (step.select(F.col("was").alias(c), F.col("now").alias(f"{c}_root")) for c in "uv")
        edges = saved(edges.join(left, "u").join(right, "v")
                      .select(F.least("u_root", "v_root").alias("u"), F.greatest("u_root", "v_root").alias("v"))
                      .where("u < v").distinct(), "edges")
    return labels
