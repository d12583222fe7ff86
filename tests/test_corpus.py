"""Corpus identity as a hash tree, and parts that declare what they hold."""

import hashlib

from pyspark.sql import functions as F

from tidewindow.operators import identity as ID
from tidewindow.sources import parts as PT

ROWS = [
    ("a", "2023-12-31 10:00:00", 1, "x"), ("a", "2024-01-01 10:00:00", 2, "y"), ("a", "2024-01-01 11:00:00", 3, None),
    ("a", "2024-02-01 10:00:00", 4, "z"), ("b", "2024-01-01 10:00:00", 5, "x"), (None, "2024-01-01 10:00:00", 6, "x"), ("b", None, 7, ""),
]


def _rows(spark, rows):
    return spark.createDataFrame(rows, "s string, t string, n int, v string").withColumn("t", F.to_timestamp("t"))


def _days(spark, rows):
    return ID.day_nodes(_rows(spark, rows), "s", F.col("t"), ("n", "v"))


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _lanes(count, digests):
    sums = [sum(int(d[i * 15 : i * 15 + 15], 16) for d in digests) for i in range(4)]
    return _sha("|".join(str(x) for x in (count, *sums)))


def _brute(rows):
    """All nodes by plain loops."""
    text = lambda x: "-" if x is None else f"{len(str(x))}:{x}"
    level, out = {}, {}
    for s, t, n, v in rows:
        level.setdefault((s or "?", t[:10] if t else "?"), []).append(_sha(text(n) + text(v)))
    level = {k: (len(d), _lanes(len(d), d)) for k, d in level.items()}
    out |= {("day", *k): x for k, x in level.items()}
    for name, width in (("month", 7), ("year", 4), ("series", 0)):
        up = {}
        for (s, p), (_, digest) in level.items():
            up.setdefault((s, None if name == "series" else p if p == "?" else p[:width]), []).append(f"{p}={digest}")
        level = {k: (len(x), _sha("|".join(sorted(x)))) for k, x in up.items()}
        out |= {(name, *k): x for k, x in level.items()}
    out["corpus", None, None] = (len(level), _lanes(len(level), [_sha(f"{s}={d}") for (s, _), (_, d) in level.items()]))
    return out


def _tree(df):
    return {(r.level, r.series, r.period): (r.children, r.sha256) for r in df.collect()}


def test_tree_against_loops_in_any_order_and_partitioning(spark):
    want = _brute(ROWS)
    assert _tree(ID.tree(_days(spark, ROWS))) == want
    shuffled = _rows(spark, ROWS[::-1]).repartition(7)
    assert _tree(ID.tree(ID.day_nodes(shuffled, "s", F.col("t"), ("n", "v")))) == want
    assert _tree(ID.tree(_days(spark, [*ROWS, ROWS[0]])))["corpus", None, None] != want["corpus", None, None]
    assert _tree(ID.tree(_days(spark, []))) == _brute([])


def test_neighbouring_columns_do_not_run_together(spark):
    one = spark.createDataFrame([("a", "1", "12")], "s string, n string, v string").withColumn("t", F.lit(None).cast("timestamp"))
    two = spark.createDataFrame([("a", "11", "2")], "s string, n string, v string").withColumn("t", F.lit(None).cast("timestamp"))
    node = lambda df: ID.day_nodes(df, "s", F.col("t"), ("n", "v")).first().sha256
    assert node(one) != node(two)


def test_changed_days_are_found_and_rebuild_the_whole(spark):
    later = [r for r in ROWS if r[2] != 4] + [("a", "2024-01-01 12:00:00", 8, "w"), ("c", "2024-03-01 00:00:00", 9, "x")]
    before, after = ID.tree(_days(spark, ROWS)), ID.tree(_days(spark, later))
    days = ID.days_changed(before, after)
    got = {tuple(r) for r in days.collect()}
    assert got == {("a", "2024-01-01", "changed"), ("a", "2024-02-01", "missing"), ("c", "2024-03-01", "added")}
    fresh = _days(spark, [r for r in later if (r[0], (r[1] or "")[:10]) in {x[:2] for x in got}])
    assert _tree(ID.refreshed(before, days, fresh)) == _brute(later)
    assert ID.days_changed(before, before).count() == 0


def test_parts_that_hold_other_series(spark, tmp_path):
    rows = spark.createDataFrame(
        [("a+b", "a+b"), ("a+b", "a+b"), ("c d", "c d"), ("x", "c d"), ("e", "e"), (None, "e")], "s string, part string"
    )
    rows.write.partitionBy("part").parquet(str(tmp_path / "p"))
    scan = PT.declared(spark.read.parquet(str(tmp_path / "p")), r"/part=([^/]+)/[^/]*$")
    got = {r.declared: (r.rows, r.mixed_rows, r.example, r.verdict) for r in PT.part_report(scan, "s").collect()}
    assert got == {"a+b": (2, 0, None, "clean"), "c d": (2, 1, "x", "mixed"), "e": (2, 1, None, "mixed")}
    assert {r.s for r in PT.clean_parts(scan, "s").collect()} == {"a+b"}
    bare = PT.declared(spark.read.parquet(str(tmp_path / "p")), r"/day=([^/]+)/")
    assert [r.verdict for r in PT.part_report(bare, "s").collect()] == ["undeclared"]
