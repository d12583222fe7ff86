"""Correlation of paired outcomes."""

import pytest

from tidewindow.operators import families as FA


@pytest.mark.parametrize("pairs, want", [
    ([(1.0, 2.0), (1.0, 3.0)], None),
    ([(2.0, 1.0), (3.0, 1.0)], None),
    ([(1.0, 1.0), (1.0, 1.0)], None),
    ([(1.0, 2.0)], None),
    ([(1.0, 2.0), (2.0, 1.0), (4.0, 5.0)], 0.8386278693775346),
])
def test_a_constant_outcome_has_no_correlation(spark, pairs, want):
    """two pairs of one outcome ended the job with a division by zero."""
    rows = [("a", i, family, x) for i, pair in enumerate(pairs) for family, x in zip(("band", "vwap"), pair)]
    trades = spark.createDataFrame(rows, "k string, at long, benchmark_family string, x double")
    (row,) = FA.paired_correlation(trades, ["k"], "at", "x").collect()
    assert row["pairs"] == len(pairs) and row["correlation"] == (want if want is None else pytest.approx(want))
