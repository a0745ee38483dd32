"""Tables, snapshot pairs and cases cut from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewitness.functions.expr import array_of, quoted
from framewitness.functions.fixed import ISSUE_TERMS
from framewitness.sources.tables import Table, read_parquet

TABLE_NAMES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)

# Statements for the case table: two or more for each route, one that two routes
# match, a blank one and a null one.
STATEMENTS = (
    "Order keys keep repeating in the extract",
    "Duplicate rows since the last load",
    "The quality field is blank for many rows",
    "Nulls appeared in the name column",
    "A missing date shows in the daily feed",
    "There is a gap in the order calendar",
    "The report total looks too low",
    "Row count changed overnight",
    "Header changed in the lang file",
    "A new column named acctbal arrived",
    "One segment disappeared from the mix",
    "Status values moved",
    "Something feels off here",
    "Repeated ids and a missing column",
    "   ",
    None,
)

# Table and baseline of a case, by the type of the event it comes from.
CASE_TABLES = {
    "click": ("orders_recent", "orders_earlier"),
    "view": ("docs_now", "docs_before"),
    "purchase": ("customers", "suppliers"),
    "signup": ("orders_recent", None),
    "error": (None, None),
}
CASE_PAIRS = (
    ("orders_recent", "orders_earlier"),
    ("docs_now", "docs_before"),
    ("customers", "suppliers"),
)


def rows(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def table(spark: SparkSession, sf: str, name: str) -> Table:
    return read_parquet(spark, f"{sf}/{name}.parquet", name)


def orders_by_date(spark: SparkSession, sf: str) -> tuple[Table, Table]:
    """Orders from 1998 on, and the orders before."""
    orders = rows(spark, sf, "orders")
    split = "TIMESTAMP_NTZ'1998-01-01 00:00:00'"
    return Table.cuts(
        orders,
        {
            "orders_recent": f"o_orderdate >= {split}",
            "orders_earlier": f"o_orderdate < {split}",
        },
        source_name=f"{sf}/orders.parquet",
        source_format="parquet",
        columnar=True,
    )


def labelled_documents(spark: SparkSession, sf: str) -> tuple[Table, Table]:
    """Documents with their labels; the current side lost the toxic labels."""
    documents, labels = rows(spark, sf, "documents"), rows(spark, sf, "labels")
    kept = documents.join(labels.filter("toxic = 0"), "doc_id", "left")
    return (
        Table.of(kept, "docs_now"),
        Table.of(documents.join(labels, "doc_id", "left"), "docs_before"),
    )


def parties(spark: SparkSession, sf: str) -> tuple[Table, Table]:
    """Customers and suppliers under one naming; supplier nations are text."""
    customers = rows(spark, sf, "customer").selectExpr(
        "c_custkey AS custkey", "c_name AS name", "c_nationkey AS nationkey",
        "c_acctbal AS acctbal", "c_mktsegment AS mktsegment",
    )
    suppliers = rows(spark, sf, "supplier").selectExpr(
        "s_suppkey AS suppkey", "s_name AS name",
        "CAST(s_nationkey AS STRING) AS nationkey", "s_acctbal AS acctbal",
    )
    return (
        Table.of(customers, "customers", columnar=True),
        Table.of(suppliers, "suppliers", columnar=True),
    )


def wide_and_narrow(spark: SparkSession, sf: str) -> tuple[Table, Table]:
    """Order lines with their part and order, 23 columns, and the regions."""
    lines = (
        rows(spark, sf, "lineitem")
        .join(rows(spark, sf, "part"), F.expr("l_partkey = p_partkey"))
        .join(rows(spark, sf, "orders"), F.expr("l_orderkey = o_orderkey"))
    )
    return Table.of(lines, "lines_wide"), table(spark, sf, "region")


LONG_DATE_TAIL = " at the counter of the branch office where the order was received"


def orders_with_long_dates(spark: SparkSession, sf: str) -> Table:
    """Orders by a text of over 64 bytes that begins with the date."""
    text = f"date_format(o_orderdate, 'yyyy/MM/dd') || {quoted(LONG_DATE_TAIL)}"
    dated = rows(spark, sf, "orders").selectExpr("o_orderkey", f"{text} AS received")
    return Table.of(dated, "orders_long", columnar=True)


def big_numbers(spark: SparkSession, sf: str) -> Table:
    """Whole numbers above 2^53, their negatives, and decimals."""
    big = rows(spark, sf, "lineitem").selectExpr(
        "l_orderkey + 9007199254740993L AS big",
        "-(l_orderkey + 9007199254740993L) AS negative",
        "CAST(l_extendedprice AS DECIMAL(15,2)) AS price",
    )
    return Table.of(big, "big", columnar=True)


def events_without_errors(spark: SparkSession, sf: str) -> tuple[Table, Table]:
    return Table.cuts(
        rows(spark, sf, "events"),
        {"events_now": "event_type <> 'error'", "events_before": None},
        columnar=True,
    )


def redelivered_orders(spark: SparkSession, sf: str) -> tuple[Table, Table]:
    """Orders with the pending ones delivered a second time, and the orders."""
    orders = rows(spark, sf, "orders")
    again = orders.unionByName(orders.filter("o_orderstatus = 'P'"))
    return (
        Table.of(again, "orders_again", columnar=True),
        Table.of(orders, "orders_once", columnar=True),
    )


def orders_with_date_text(spark: SparkSession, sf: str) -> Table:
    dated = rows(spark, sf, "orders").selectExpr(
        "* EXCEPT (o_orderdate)",
        "date_format(o_orderdate, 'yyyy-MM-dd') AS o_orderdate",
    )
    return Table.of(dated, "orders_text", columnar=True)


def issue_cases(spark: SparkSession, sf: str) -> DataFrame:
    """One case per event: its statement by number, its tables by type."""
    statements = ", ".join(
        quoted(s) if s is not None else "CAST(NULL AS STRING)" for s in STATEMENTS
    )

    def by_type(which: int) -> str:
        whens = " ".join(
            f"WHEN {quoted(event)} THEN {quoted(pair[which])}"
            for event, pair in CASE_TABLES.items()
        )
        return f"CASE event_type {whens} END"

    return rows(spark, sf, "events").selectExpr(
        "event_id AS case_id",
        f"array({statements})[int(event_id % {len(STATEMENTS)})] AS issue_statement",
        f"{by_type(0)} AS dataset_id",
        f"{by_type(1)} AS baseline_id",
    )


# What is planted into texts: every term that selects a type, and words of column names.
PLANTED_TERMS = tuple(term for terms in ISSUE_TERMS.values() for term in terms)
PLANTED_WORDS = (
    "", "orderkey", "acctbal column", "of text and lang", "nationkey", "sourc",
    "totalprice orderdate", "ty char", "o priority", "NAME",
)
# Table and baseline of a text, by what it is: a language or a role.
TEXT_TABLES = {
    "en": ("orders_recent", "orders_earlier"),
    "de": ("docs_now", "docs_before"),
    "fr": ("customers", None),
    "es": (None, None),
    "user": ("docs_now", None),
    "assistant": ("customers", "suppliers"),
    "system": ("orders_recent", "orders_earlier"),
}


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """case_id, number, made_of and text of all documents and all turns."""
    documents = rows(spark, sf, "documents").selectExpr(
        "concat('d', doc_id) AS case_id", "doc_id AS number", "lang AS made_of", "text"
    )
    turns = rows(spark, sf, "conversations").selectExpr(
        "concat('c', conv_id, '/', turn) AS case_id",
        "conv_id * 7 + turn AS number",
        "role AS made_of",
        "text",
    )
    return documents.unionByName(turns)


def marked_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Cases over whole texts, four of five with an issue planted in the middle."""
    half = "int(length(text) / 2)"
    term = f"{array_of(PLANTED_TERMS)}[int(number % {len(PLANTED_TERMS)})]"
    words = f"{array_of(PLANTED_WORDS)}[int(number % {len(PLANTED_WORDS)})]"
    planted = f"left(text, {half}) || ' ' || {term} || ' ' || {words} || substr(text, {half} + 1)"

    def by_kind(which: int) -> str:
        whens = " ".join(
            f"WHEN {quoted(kind)} THEN {quoted(pair[which])}"
            for kind, pair in TEXT_TABLES.items()
        )
        return f"CASE made_of {whens} END"

    return texts(spark, sf).selectExpr(
        "case_id",
        f"IF(number % 5 = 0, text, {planted}) AS issue_statement",
        f"{by_kind(0)} AS dataset_id",
        f"{by_kind(1)} AS baseline_id",
    )


# What is stored of a case, by the number of its event: stage names and their status.
STORED = (
    (),
    ("evidence",),
    ("evidence", "hypotheses"),
    ("evidence", "hypotheses", "findings"),
    ("evidence", "hypotheses", "findings", "report"),
    ("evidence", "hypotheses", "findings", "report", "notes"),
    ("evidence", "hypotheses", "findings", "report", "notes failed"),
)


def stored_stages(spark: SparkSession, sf: str) -> DataFrame:
    """A manifest with stages of every event that is a case."""
    sets = ", ".join(array_of(stages) for stages in STORED)
    return rows(spark, sf, "events").selectExpr(
        f"explode(array({sets})[int(event_id % {len(STORED)})]) AS entry", "event_id"
    ).selectExpr(
        "split(entry, ' ')[0] AS stage",
        "CAST(event_id AS STRING) AS case_id",
        "IF(endswith(entry, ' failed'), 'failed', 'completed') AS status",
    )
