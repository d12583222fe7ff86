"""Who may enter: a decision per event, taken before any entry path is looked up.

A gate is any ``DataFrame -> DataFrame`` that keeps the events' columns and adds the columns of
``DECISION``.  Rejected events keep their decision, and never meet a bar.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from tidewindow.operators.quality import require

DECISION = {
    "eligible": "boolean", "filter_family": "string", "filter_spec_id": "string", "filter_metadata": "map<string,string>",
}
Gate = Callable[[DataFrame], DataFrame]


def accept_all(events: DataFrame) -> DataFrame:
    """The default gate: every event is eligible."""
    return events.withColumns(
        {
            "eligible": F.lit(True),
            "filter_family": F.lit("none"),
            "filter_spec_id": F.lit("none-v1"),
            "filter_metadata": F.create_map().cast("map<string,string>"),
        }
    )


def all_gates(*gates: Gate) -> Gate:
    """All of several gates: eligible where each says so, labelled by the first that rejects."""

    def gate(events: DataFrame) -> DataFrame:
        rows = decide(events, gates[0])
        for other in gates[1:]:
            first = F.struct(*DECISION).alias("_first")
            rows = decide(rows.select(*events.columns, first), other)
            taken = F.when(F.col("_first.eligible"), F.struct(*DECISION)).otherwise(F.col("_first"))
            rows = rows.select(*events.columns, taken.alias("_taken")).select(*events.columns, "_taken.*")
        return rows

    return gate


def decide(events: DataFrame, gate: Gate = accept_all) -> DataFrame:
    """Events with the gate's decision.  A gate that loses columns or types is refused when the
    plan is built; a decision of NULL fails the job."""
    rows = gate(events)
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    lost = [c for c in events.columns if c not in types]
    wrong = [f"{k} {types.get(k, 'missing')}" for k, v in DECISION.items() if types.get(k) != v]
    if lost or wrong:
        raise ValueError(f"gate breaks its contract: lost {lost}, decision {wrong}")
    rows = require(rows, F.col("eligible").isNull(), "an eligibility decision is NULL")
    return rows.select(*events.columns, *[c for c in DECISION if c not in events.columns])


def admitted(events: DataFrame, gate: Gate = accept_all) -> DataFrame:
    """The eligible events under their filter's name: what entry paths are attached to."""
    return decide(events, gate).where("eligible").drop("eligible", "filter_metadata")
