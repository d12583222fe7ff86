"""The registry, its statements, and a sample of both side by side."""

import pytest

import checks
import oracles
from tidewindow.plans import registry

SF = "/root/testdata/sf0.001"


def test_every_statement_has_a_query():
    assert set(oracles.QUERIES) <= set(registry())
    assert set(registry()) - set(oracles.QUERIES) == {"residual_shocks", "walk_forward_models"}


@pytest.mark.parametrize("name", ["bar_ingest", "resample_bars", "band_features", "structural_levels", "spread_profile"])
def test_against_duckdb(spark, name):
    con = checks.connect(SF)
    line = checks.compare(spark, name, registry()[name], oracles.QUERIES[name], SF, con)
    assert line.startswith("OK"), line
