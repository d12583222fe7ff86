"""Connected components of a distributed graph, by alternating large and small stars.

A step points every node at the smallest neighbour it knows; steps end when the edges stay as they
are.  Each step is written to the shared folder, so lineage stays short and lost executors cost one
step.  A node with very many edges is aggregated map-side, and the join back on it is a plain join
that AQE splits.
"""

from pyspark.sql import DataFrame, functions as F

from tidewindow.sources.staging import stage

STEPS = 60


def _smallest(edges: DataFrame) -> DataFrame:
    return stage(edges.groupBy("a").agg(F.min("b").alias("m"))).withColumnRenamed("a", "of")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _smallest(both).select("of", F.least("of", "m").alias("m"))
    out = both.where("b > a").join(least, F.col("a") == F.col("of")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return stage(out.where("a != b").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges point down (a > b)."""
    least = _smallest(edges)
    joined = edges.join(least, F.col("a") == F.col("of"))
    moved = joined.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    kept = least.select(F.col("of").alias("a"), F.col("m").alias("b"))
    down = moved.unionByName(kept).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return stage(down.where("a != b").distinct())


def _state(edges: DataFrame):
    """Count and order-free hash of the edges: two rows of figures, not the edges."""
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node reachable.

    Nodes are longs; loops and repeated edges are allowed; the roots themselves are in the result.
    """
    down = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = stage(down.distinct())
    before = None
    for _ in range(STEPS):
        state = _state(now)
        if state == before or not state[0]:
            break
        before = state
        now = _small_star(_large_star(now))
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        roots.select("node", F.col("node").alias("root"))
    )
