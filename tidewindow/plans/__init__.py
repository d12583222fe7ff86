"""Registered queries, grouped by study."""

# What the studies expect of a session.  The JIT never compiles methods above 8000 bytecodes; wide
# projections are better off without whole-stage code than interpreted inside one huge method.
SESSION = {"spark.sql.session.timeZone": "UTC", "spark.sql.codegen.hugeMethodLimit": "8000"}


def registry():
    from importlib import import_module

    out = {}
    for module in ("foundation", "benchmarks", "pathways", "grid", "families", "process", "structure", "ranking", "corpus"):
        try:
            out |= import_module(f"tidewindow.plans.{module}").QUERIES
        except ModuleNotFoundError as error:
            if not str(error.name).startswith("tidewindow.plans."):
                raise
    return out
