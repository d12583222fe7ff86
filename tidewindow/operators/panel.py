"""Synchronized panels and rolling principal-component residuals."""

from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import pandas_udf

from tidewindow.operators.chunks import core_only, halo, running_sum
from tidewindow.operators.events import shock_episodes


def synchronized_panel(bars: DataFrame, universe: Column, member: Column, members) -> DataFrame:
    """Wide closes per universe on the clocks all members share (p0, p1, ... in member order)."""
    rows = bars.select(universe.alias("universe"), member.alias("_member"), F.unix_seconds("open_time").alias("t"), "close")
    wide = rows.groupBy("universe", "t").agg(
        *[F.max(F.when(F.col("_member") == m, F.col("close"))).alias(f"p{i}") for i, m in enumerate(members)]
    )
    return wide.dropna()


def panel_violations(panel: DataFrame, members) -> DataFrame:
    """Per universe: clocks, repeated clocks, non-finite and non-positive prices."""
    cols = [F.col(f"p{i}") for i in range(len(members))]
    bad = reduce(lambda a, b: a | b, [F.isnan(c) | (F.abs(c) == float("inf")) for c in cols])
    low = reduce(lambda a, b: a | b, [c <= 0 for c in cols])
    return panel.groupBy("universe").agg(
        F.count("*").alias("clocks"),
        F.count_distinct("t").alias("distinct_clocks"),
        F.count_if(bad).alias("non_finite"),
        F.count_if(low).alias("non_positive"),
        F.min("t").alias("first_s"),
        F.max("t").alias("last_s"),
    )


def _projector(size: int, components: int):
    """Arrow UDF: reconstruct each row from the leading eigenvectors of its correlation."""
    pairs = list(combinations(range(size), 2))

    @pandas_udf("array<double>")
    def reconstruct(current: pd.Series, correlations: pd.Series) -> pd.Series:
        if not len(current):
            return pd.Series([], dtype=object)
        x = np.stack([np.asarray(v, dtype=float) for v in current])
        rho = np.stack([np.asarray(v, dtype=float) for v in correlations])
        matrix = np.tile(np.eye(size), (len(x), 1, 1))
        for k, (i, j) in enumerate(pairs):
            matrix[:, i, j] = matrix[:, j, i] = rho[:, k]
        _, vectors = np.linalg.eigh(matrix)
        lead = vectors[:, :, -components:]
        back = np.einsum("nik,njk,nj->ni", lead, lead, x)
        return pd.Series(list(back))

    return reconstruct


def pca_residuals(
    panel: DataFrame, members, window: int, components: int, normalize: int, width: int, rank_width: int = 4096
) -> DataFrame:
    """Residual and prior-only z-score of each member at each clock of its universe's panel.

    Rows are ranked once (chunked prefix count), then cut into rank chunks that carry the
    ``window + normalize`` rows both rolling frames need.  The covariance of returns that were
    standardised over the same frame is their correlation, so Spark aggregates it and Python
    only sees one small symmetric matrix per row.
    """
    size = len(members)
    if components >= size:
        raise ValueError("components must leave at least one residual dimension")
    ranked = running_sum(panel, ["universe"], "t", F.col("t"), width, F.lit(1), "rank")
    placed = halo(ranked, F.col("rank"), rank_width, back=window + normalize + 2)
    order = Window.partitionBy("universe", "_chunk").orderBy("rank")
    rows = placed.withColumns(
        {f"r{i}": F.ln(f"p{i}") - F.ln(F.lag(f"p{i}").over(order)) for i in range(size)}
    )
    prior = order.rowsBetween(-window, -1)
    stats = {}
    for i in range(size):
        stats[f"m{i}"] = F.avg(f"r{i}").over(prior)
        stats[f"s{i}"] = F.stddev_samp(f"r{i}").over(prior)
    for i, j in combinations(range(size), 2):
        stats[f"c{i}_{j}"] = F.corr(f"r{i}", f"r{j}").over(prior)
    stats["_have"] = F.count("r0").over(prior)
    rows = rows.withColumns(stats).where(F.col("_have") == window)
    rows = rows.withColumns(
        {
            "_x": F.array(*[(F.col(f"r{i}") - F.col(f"m{i}")) / F.col(f"s{i}") for i in range(size)]),
            "_rho": F.array(*[F.col(f"c{i}_{j}") for i, j in combinations(range(size), 2)]),
        }
    )
    rows = rows.select("universe", "t", "rank", "_chunk", "_core", "_x", "_rho", *[f"r{i}" for i in range(size)])
    rows = rows.withColumn("_back", _projector(size, components)("_x", "_rho")).drop("_rho")
    rows = rows.withColumns({f"e{i}": F.col("_x")[i] - F.col("_back")[i] for i in range(size)})
    history = order.rowsBetween(-normalize, -1)
    rows = rows.withColumns(
        {
            "_rhave": F.count("e0").over(history),
            **{
                f"z{i}": (F.col(f"e{i}") - F.avg(f"e{i}").over(history)) / F.stddev_samp(f"e{i}").over(history)
                for i in range(size)
            },
        }
    ).where(F.col("_rhave") == normalize)
    rows = core_only(rows)
    items = F.array(
        *[
            F.struct(
                F.lit(m).alias("member"),
                F.col(f"r{i}").alias("log_return"),
                F.col("_x")[i].alias("standardized_return"),
                F.col("_back")[i].alias("reconstruction"),
                F.col(f"e{i}").alias("residual"),
                F.col(f"z{i}").alias("residual_z"),
            )
            for i, m in enumerate(members)
        ]
    )
    return rows.select("universe", "t", F.inline(items))


def residual_shocks(residuals: DataFrame, width: int, enter: float = 2.0, leave: float = 1.0) -> DataFrame:
    return shock_episodes(residuals, ["universe", "member"], "t", width, "residual_z", enter, leave)
