from __future__ import annotations

from framewitness import Table


def table(spark, rows, schema, dataset_id="t", *, columnar=True, names=None) -> Table:
    df = spark.createDataFrame(rows, schema)
    return Table.of(df, dataset_id, names, columnar=columnar)


def by_name(profile) -> dict:
    return {row["column_name"]: row for row in profile.collect()}


CURRENT = [
    ("K-01", "ann@a.example", "2026-05-20", "open", "north", 10.5),
    ("K-02", "bob@a.example", "2026-05-20", "open", "south", 20.0),
    ("K-03", None, "2026-05-21", "shut", "east", 0.0),
    ("K-04", "dan@a.example", "2026-05-21", "open", "west", 510.1),
    ("K-05", "eve@a.example", "2026-05-22", "held", "north", 99.9),
    ("K-06", "fay@a.example", "2026-05-22", "open", "south", 81.3),
    ("K-07", None, "2026-05-23", "shut", "east", 150.0),
    ("K-08", "hal@a.example", "2026-05-23", "open", "west", 200.0),
    ("K-09", "ida@a.example", "2026-05-24", "held", "north", 250.0),
    ("K-10", "jon@a.example", "2026-05-24", "open", "south", 150.0),
    ("K-11", "kim@a.example", "2026-05-25", "shut", "east", 125.0),
    ("K-01", "lea@a.example", "2026-05-25", "open", "west", 125.0),
]
BASELINE = [
    (f"K-{i:02d}", f"person{i:02d}@a.example", f"2026-05-{20 + i // 2}", s, r, 140.0)
    for i, (s, r) in enumerate(
        [("open", "north"), ("shut", "south"), ("held", "east"), ("open", "west")] * 3
    )
]
SCHEMA = (
    "customer_id string, email string, signup_date string, status string,"
    " region string, worth double"
)


def snapshots(spark):
    return (
        table(spark, CURRENT, SCHEMA, "now"),
        table(spark, BASELINE, SCHEMA, "before"),
    )


def cases(spark, *rows):
    """Rows of (statement, dataset_id, baseline_id)."""
    return spark.createDataFrame(
        [(i, *row) for i, row in enumerate(rows)],
        "case_id int, issue_statement string, dataset_id string, baseline_id string",
    )
