"""Current table against baseline table, from their column profiles.

``pairs`` has current_id and baseline_id. The result holds one row per pair with
one struct per section. Only profile rows are joined and grouped, so the work
grows with the number of columns, never with the data. Where a display name is
repeated, its first column stands for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewitness.functions.expr import contains_any, pct, struct_of
from framewitness.functions.fixed import CATEGORY_SHARE_LIMIT, KEY_TERMS
from framewitness.operators.profile import TABLE_MEASURES

_KEY = ["current_id", "baseline_id"]

_COLUMN_FIELDS = (
    "inferred_kind", "row_count", "null_count", "null_percentage", "unique_count",
    "duplicate_value_count", "num_total", "day_min", "day_max", "dt_missing_days",
)


_SIDES = ("c", "b")


def matched_columns(profile: DataFrame, pairs: DataFrame) -> DataFrame:
    """Both sides' columns by name, structs c and b, from one reading of the profile.

    Every column meets the pairs its table is in, on the side it takes there, and the
    two sides of a name are grouped. Measures of the tables come along per name.
    """
    sides = pairs.select(*_KEY).distinct().selectExpr(
        *_KEY,
        "inline(array(struct('c' AS side, current_id AS dataset_id),"
        " struct('b' AS side, baseline_id AS dataset_id)))",
    )
    fields = f"struct({', '.join(_COLUMN_FIELDS)})"
    found = {}
    for side in _SIDES:
        chosen = f"side = '{side}'"
        first = f"IF({chosen} AND name_occurrence = 1, {fields}, NULL)"
        found[side] = f"any_value({first}, true)"
        for name, (of, call) in TABLE_MEASURES.items():
            found[f"{side}_{name}"] = f"{call}(IF({chosen}, {of}, NULL))"
    return (
        profile.join(sides, "dataset_id")
        .groupBy(*_KEY, "column_name")
        .agg(*[F.expr(text).alias(name) for name, text in found.items()])
    )


def _derive(matched: DataFrame) -> DataFrame:
    """Which sections a column takes part in, and its deltas there."""
    number = "IN ('integer', 'decimal')"
    share_c = pct("c.unique_count", "c.row_count")
    share_b = pct("b.unique_count", "b.row_count")
    category = "inferred_kind IN ('text', 'boolean')"
    return (
        matched.selectExpr(
            *_KEY,
            "column_name",
            "c",
            "b",
            *[f"{side}_{name}" for side in _SIDES for name in TABLE_MEASURES],
            "c IS NOT NULL AND b IS NOT NULL AS shared",
            f"{share_c} AS c_share",
            f"{share_b} AS b_share",
        )
        .selectExpr(
            "*",
            f"shared AND c.inferred_kind {number} AND b.inferred_kind {number} AS is_num",
            "shared AND c.inferred_kind = 'datetime' AND b.inferred_kind = 'datetime'"
            " AS is_date",
            f"shared AND c.{category} AND b.{category}"
            f" AND c_share <= {CATEGORY_SHARE_LIMIT} AND b_share <= {CATEGORY_SHARE_LIMIT}"
            " AS is_category",
            f"shared AND {contains_any('lower(column_name)', KEY_TERMS)} AS is_key",
        )
        .selectExpr(
            "*",
            "IF(shared, round(c.null_percentage - b.null_percentage, 2), NULL) AS d_null",
            "IF(is_num, round(c.num_total - b.num_total, 2), NULL) AS d_num",
            "IF(is_date, c.dt_missing_days - b.dt_missing_days, NULL) AS d_days",
            "IF(is_date, NOT (c.day_min <=> b.day_min AND c.day_max <=> b.day_max), NULL)"
            " AS d_range",
            "IF(is_category, c.unique_count - b.unique_count, NULL) AS d_unique",
            f"IF(is_category, c_share > {CATEGORY_SHARE_LIMIT}, NULL) AS c_high",
            f"IF(is_category, b_share > {CATEGORY_SHARE_LIMIT}, NULL) AS b_high",
            "IF(is_key, c.duplicate_value_count - b.duplicate_value_count, NULL) AS d_dup",
        )
    )


def _details(condition: str, order: str, **fields: str) -> str:
    """The rows of a section by size of change, then name."""
    entry = struct_of(ord=order, column_name="column_name", **fields)
    collected = f"array_sort(collect_list(IF({condition}, {entry}, NULL)))"
    names = ["column_name", *fields]
    plain = struct_of(**{name: f"x.{name}" for name in names})
    return f"transform({collected}, x -> {plain})"


def _sections() -> dict[str, str]:
    return {
        "added": "array_sort(collect_list(IF(b IS NULL, column_name, NULL)))",
        "removed": "array_sort(collect_list(IF(c IS NULL, column_name, NULL)))",
        "shared_column_count": "count_if(shared)",
        "kind_change_count": "count_if(shared AND c.inferred_kind <> b.inferred_kind)",
        "kind_changes": _details(
            "shared AND c.inferred_kind <> b.inferred_kind",
            "0",
            current_kind="c.inferred_kind",
            baseline_kind="b.inferred_kind",
        ),
        "nulls": struct_of(
            columns_compared="count_if(shared)",
            columns_higher="count_if(d_null > 0)",
            columns_lower="count_if(d_null < 0)",
            max_absolute_delta="coalesce(max(abs(d_null)), 0.0D)",
            details=_details(
                "d_null <> 0",
                "-abs(d_null)",
                current_null_count="c.null_count",
                baseline_null_count="b.null_count",
                current_null_percentage="c.null_percentage",
                baseline_null_percentage="b.null_percentage",
                delta_percentage="d_null",
            ),
        ),
        "numbers": struct_of(
            columns_compared="count_if(is_num)",
            columns_with_delta="count_if(d_num <> 0)",
            max_absolute_delta="coalesce(max(abs(d_num)), 0.0D)",
            details=_details(
                "d_num <> 0",
                "-abs(d_num)",
                current_total="round(c.num_total, 2)",
                baseline_total="round(b.num_total, 2)",
                delta="d_num",
                delta_percentage=pct("d_num", "b.num_total"),
            ),
        ),
        "dates": struct_of(
            columns_compared="count_if(is_date)",
            columns_with_range_change="count_if(d_range)",
            columns_with_missing_delta="count_if(d_days <> 0)",
            details=_details(
                "d_range OR d_days <> 0",
                "0",
                current_min_date="c.day_min",
                current_max_date="c.day_max",
                baseline_min_date="b.day_min",
                baseline_max_date="b.day_max",
                current_missing_days="c.dt_missing_days",
                baseline_missing_days="b.dt_missing_days",
                missing_days_delta="d_days",
                range_changed="d_range",
            ),
        ),
        "categories": struct_of(
            columns_compared="count_if(is_category)",
            columns_with_delta="count_if(d_unique <> 0)",
            max_absolute_delta="coalesce(max(abs(d_unique)), 0L)",
            columns_with_flag_delta="count_if(c_high <> b_high)",
            details=_details(
                "d_unique <> 0 OR c_high <> b_high",
                "-abs(d_unique)",
                current_unique_count="c.unique_count",
                baseline_unique_count="b.unique_count",
                unique_count_delta="d_unique",
                current_unique_percentage="c_share",
                baseline_unique_percentage="b_share",
                unique_percentage_delta="round(c_share - b_share, 2)",
                current_high_cardinality="c_high",
                baseline_high_cardinality="b_high",
            ),
        ),
        "duplicates": struct_of(
            columns_compared="count_if(is_key)",
            columns_higher="count_if(d_dup > 0)",
            columns_lower="count_if(d_dup < 0)",
            max_absolute_delta="coalesce(max(abs(d_dup)), 0L)",
            details=_details(
                "d_dup <> 0",
                "-abs(d_dup)",
                current_duplicate_count="c.duplicate_value_count",
                baseline_duplicate_count="b.duplicate_value_count",
                duplicate_count_delta="d_dup",
            ),
        ),
    }


_SUMMARY_DELTAS = {
    "row_count_delta": "row_count",
    "column_count_delta": "column_count",
    "total_null_cell_delta": "total_null_cells",
    "numeric_column_count_delta": "numeric_column_count",
    "datetime_column_count_delta": "datetime_column_count",
    "text_column_count_delta": "text_column_count",
    "duplicate_column_name_count_delta": "duplicate_column_name_count",
    "empty_column_name_count_delta": "empty_column_name_count",
}


def compare(profile: DataFrame, pairs: DataFrame) -> DataFrame:
    """Every comparison section, one row per pair of tables that the profile holds.

    Details and names are complete. What the profile did not measure is null there,
    and counts as no difference.
    """
    sections = _sections()
    for side in _SIDES:
        whole = {n: f"{call}({side}_{n})" for n, (_, call) in TABLE_MEASURES.items()}
        sections[f"{side}_table"] = struct_of(**whole)
    grouped = (
        _derive(matched_columns(profile, pairs))
        .groupBy(*_KEY)
        .agg(*[F.expr(text).alias(name) for name, text in sections.items()])
        .filter("c_table.column_count > 0 AND b_table.column_count > 0")
        .withColumnsRenamed({"c_table": "c", "b_table": "b"})
    )

    def change(measure: str) -> str:
        delta = f"(c.{measure} - b.{measure})"
        return struct_of(
            current=f"c.{measure}",
            baseline=f"b.{measure}",
            delta=delta,
            delta_percentage=pct(delta, f"b.{measure}"),
        )

    schema = struct_of(
        current_column_count="c.column_count",
        baseline_column_count="b.column_count",
        added_columns="added",
        removed_columns="removed",
        shared_column_count="shared_column_count",
        current_duplicate_names="c.duplicate_column_name_count",
        baseline_duplicate_names="b.duplicate_column_name_count",
        current_empty_names="c.empty_column_name_count",
        baseline_empty_names="b.empty_column_name_count",
        kind_change_count="kind_change_count",
        kind_changes="kind_changes",
    )
    general = struct_of(
        **{name: f"c.{of} - b.{of}" for name, of in _SUMMARY_DELTAS.items()}
    )
    signals = (
        "size(schema.added_columns) + size(schema.removed_columns)"
        " + kind_change_count + nulls.columns_higher + nulls.columns_lower"
    )
    return (
        grouped.selectExpr(
            *_KEY,
            f"{change('row_count')} AS rows",
            f"{change('column_count')} AS column_counts",
            f"{schema} AS schema",
            "nulls",
            "numbers",
            "dates",
            "categories",
            "duplicates",
            f"{general} AS general",
            "kind_change_count",
            "shared_column_count AS compared_column_count",
        )
        .withColumn("signal_count", F.expr(f"bigint({signals})"))
        .drop("kind_change_count")
    )


def with_sources(comparison: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds where both sides come from: structs current_source and baseline_source.

    ``sources`` has dataset_id, source_name and source_format (``table_sources``); a side
    that it does not have gets null.
    """
    for side in ("current", "baseline"):
        own = sources.selectExpr(
            f"dataset_id AS {side}_id",
            f"struct(source_name AS name, source_format AS format) AS {side}_source",
        )
        comparison = comparison.join(own, f"{side}_id", "left")
    return comparison


def source_rows(comparison: DataFrame) -> DataFrame:
    """Name, format and shape of both sides, one row per pair; the name has no folders."""
    file_name = "regexp_extract({0}_source.name, '([^/]*)/*$', 1) AS {0}_name"
    return comparison.selectExpr(
        *_KEY,
        *[
            text.format(side)
            for side in ("current", "baseline")
            for text in (
                file_name, "{0}_source.format AS {0}_format", "rows.{0} AS {0}_row_count",
                "column_counts.{0} AS {0}_column_count",
            )
        ],
    )


def details(comparison: DataFrame, section: str) -> DataFrame:
    """Detail rows of one section (nulls, numbers, dates, categories, duplicates)."""
    source = "schema.kind_changes" if section == "kind_changes" else f"{section}.details"
    return comparison.selectExpr(*_KEY, f"inline({source})")


def summary(comparison: DataFrame, section: str) -> DataFrame:
    """The counts of one section."""
    chosen = comparison.selectExpr(*_KEY, f"{section}.*")
    return chosen.drop("details", "kind_changes")
