from __future__ import annotations

import json

import pytest
from helpers import by_name, table

from framewitness import read_csv, read_parquet, read_table
from framewitness.operators import notes, safety
from framewitness.operators import profile as P
from framewitness.sources import stage_table, type_inference, write_stage


def _csv(tmp_path, text, name="t.csv"):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv_types_and_null_tokens(spark, tmp_path):
    path = _csv(
        tmp_path,
        "whole,real,flag,word,gone,sci,long,big,spaced,mix\n"
        "1,1.5,True,a,NA,1e3,99999999999999999999,9223372036854775808, 1,1\n"
        "2,inf,FALSE,N/A,,-.5,1,1,2 ,x\n"
        "null,,,\"x,\"\"y\",None,2.,2,2,+3,1d\n",
    )
    t = read_csv(spark, path, "t")
    kinds = {n: f.dataType.simpleString() for n, f in
             zip(t.names, t.frame.schema.fields)}
    assert kinds == {
        "whole": "bigint", "real": "double", "flag": "boolean", "word": "string",
        "gone": "double", "sci": "double", "long": "string", "big": "decimal(20,0)",
        "spaced": "bigint", "mix": "string",
    }
    rows = by_name(P.column_profile(t))
    assert rows["whole"].null_count == 1 and rows["word"].null_count == 1
    assert rows["gone"].inferred_kind == "empty" and rows["gone"].is_numeric_type
    assert rows["spaced"].num_total == 6.0
    assert rows["sci"].num_total == 1001.5
    words = {r[0] for r in t.frame.select("c3").collect()}
    assert words == {"a", None, 'x,"y'}


def test_csv_header_names_stay_as_written(spark, tmp_path):
    t = read_csv(spark, _csv(tmp_path, "﻿a,a,,b\n1,2,3,4\n"), "t")
    assert t.names == ("a", "a", "", "b")
    summary = P.table_summary(P.column_profile(t)).collect()[0]
    assert summary.duplicate_column_name_count == 1
    assert summary.empty_column_name_count == 1
    shape = t.shape().collect()[0]
    assert (shape.source_format, shape.row_count, shape.column_count) == ("csv", 1, 4)


def test_csv_without_rows(spark, tmp_path):
    t = read_csv(spark, _csv(tmp_path, "a,b\n"), "t")
    assert by_name(P.column_profile(t))["a"].inferred_kind == "empty"


def test_bad_sources_raise(spark, tmp_path):
    with pytest.raises(ValueError, match="does not exist"):
        read_csv(spark, str(tmp_path / "none.csv"), "t")
    with pytest.raises(ValueError, match="unsupported extension"):
        read_csv(spark, _csv(tmp_path, "{}", "t.json"), "t")
    with pytest.raises(ValueError, match="sheet"):
        read_csv(spark, _csv(tmp_path, "a\n1\n"), "t", sheet="one")
    with pytest.raises(ValueError, match="unsupported extension"):
        read_parquet(spark, _csv(tmp_path, "a\n1\n", "u.csv"), "t")
    with pytest.raises(ValueError, match="does not exist"):
        read_table(spark, "no_such_table", "t")


def test_csv_rows_that_do_not_fit_raise(spark, tmp_path):
    with pytest.raises(ValueError, match="1 rows .* more cells"):
        read_csv(spark, _csv(tmp_path, "a,b\n1,2\n3,4,5\n6\n"), "t")
    with pytest.raises(ValueError, match="1 rows .* more cells"):
        read_csv(spark, _csv(tmp_path, "a,b\n1,2,\n"), "t")
    short = read_csv(spark, _csv(tmp_path, "a,b\n1,2\n6\n"), "t")
    assert sorted(map(tuple, short.frame.collect()), key=repr) == [(1, 2), (6, None)]


def test_csv_line_breaks_in_cells(spark, tmp_path):
    path = _csv(tmp_path, 'a,b\n1,"x\ny"\n2,"says ""hi"""\n')
    with pytest.raises(ValueError, match="multiline=True"):
        read_csv(spark, path, "t")
    whole = read_csv(spark, path, "t", multiline=True)
    assert sorted(map(tuple, whole.frame.collect())) == [(1, "x\ny"), (2, 'says "hi"')]


def test_csv_files_share_a_header(spark, tmp_path):
    folder = tmp_path / "two.csv"
    folder.mkdir()
    (folder / "one.csv").write_text("a,b\n1,2\n")
    (folder / "two.csv").write_text("b,a\n1,2\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_csv(spark, str(folder), "t").frame.collect()


def test_lake_sources(spark, tmp_path):
    df = spark.range(4).selectExpr("id", "id % 2 AS part")
    df.write.partitionBy("part").parquet(str(tmp_path / "orders_folder"))
    t = read_parquet(spark, str(tmp_path / "orders_folder"), "t")
    assert t.columnar and sorted(t.names) == ["id", "part"] and t.frame.count() == 4
    with pytest.raises(ValueError, match="does not exist"):
        read_parquet(spark, str(tmp_path / "nowhere"), "t")
    df.createOrReplaceTempView("a_view")
    assert not read_table(spark, "a_view", "t").columnar


def test_forbidden_keys_in_values(spark, tmp_path):
    good = "SELECT 1 AS case_id, '{\"kinds\": 1}' AS text, map('a', array('b')) AS m"
    write_stage(spark.sql(good), str(tmp_path / "good"), fmt="parquet")
    for bad in (
        "SELECT 1 AS case_id, '{\"top_values\" : [1]}' AS text",
        "SELECT 1 AS case_id, map('top_values', 1) AS m",
        "SELECT 1 AS case_id, array(named_struct('x', '{\"examples\":1}')) AS x",
    ):
        with pytest.raises(Exception, match="must not be written"):
            write_stage(spark.sql(bad), str(tmp_path / "bad"), fmt="parquet")


def test_type_inference_rows(spark):
    t = table(spark, [("1", "x"), ("2", "")], "a string, b string")
    rows = {r.column_name: (r.inferred_type, r.non_null_count)
            for r in type_inference(t).collect()}
    assert rows == {"a": ("bigint", 2), "b": ("string", 1)}


def test_stage_tables_keep_schema_and_refuse_forbidden_fields(spark, tmp_path):
    t = table(spark, [(1, "x"), (2, None)], "a int, b string")
    profile = P.column_profile(t)
    staged = stage_table(profile, str(tmp_path), "test")
    assert staged.dtypes == profile.dtypes and staged.count() == 2
    out = str(tmp_path / "out")
    rows = spark.createDataFrame([(1, "x")], "case_id int, check_id string")
    write_stage(rows, out, by_case=True)
    assert spark.read.json(out).count() == 1
    write_stage(rows, out, fmt="parquet")
    assert spark.read.parquet(out).count() == 1
    with pytest.raises(ValueError):
        write_stage(rows, out, fmt="csv")
    leaky = spark.sql("SELECT 1 AS case_id, array(named_struct('top_values', 1)) AS x")
    with pytest.raises(ValueError, match="top_values"):
        write_stage(leaky, out)


def test_forbidden_fields_at_any_depth(spark):
    schema = spark.sql(
        "SELECT map('a', named_struct('examples', 1)) AS m, 1 AS row_numbers"
    ).schema
    assert sorted(safety.forbidden_fields(schema)) == ["examples", "row_numbers"]


def test_blocked_terms(spark):
    texts = ["All APPROVED now", "fine", None, "a raw_values b", "the Root Cause Identified"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    found = [r[0] for r in df.selectExpr(safety.has_blocked_term("text")).collect()]
    assert found == [True, False, False, True, True]
    listed = df.selectExpr(safety.blocked_terms("text")).first()[0]
    assert listed == ["proved", "approved"]
    scan = safety.scan_blocked_terms(df, "text", "t").first()
    assert (scan.rows_scanned, scan.rows_hit) == (5, 3)


def test_every_blocked_term_is_found(spark):
    from framewitness.functions.fixed import BLOCKED_TERMS

    df = spark.createDataFrame([(f"see {t.upper()}!",) for t in BLOCKED_TERMS], "t string")
    assert df.filter(safety.has_blocked_term("t")).count() == len(BLOCKED_TERMS)
    near = spark.createDataFrame([("raw rows, _rows, value_, raw_ and _values",)], "t string")
    assert near.filter(safety.has_blocked_term("t")).count() == 0


def _note(**changes):
    note = {
        "review_summary": "Look at these examples.",
        "suggested_follow_up_questions": ["Who owns the key?"],
        "suggested_human_checks": [],
        "communication_notes": [],
        "limitations_to_keep_visible": ["A person reviews."],
    }
    note.update(changes)
    return json.dumps({k: v for k, v in note.items() if v != "drop"})


def test_notes(spark):
    many = "suggested_human_checks"
    cases = [
        (_note(), []),
        ("not json", ["not_json"]),
        (None, ["not_json"]),
        ("[1]", ["not_an_object"]),
        ('"text"', ["not_an_object"]),
        (_note(extra=1), ["unexpected_keys"]),
        (_note(communication_notes="drop"),
         ["missing_keys", "communication_notes:not_a_list"]),
        (_note(review_summary=1), ["review_summary:not_text"]),
        (_note(review_summary="é" * 1000), []),
        (_note(review_summary="é" * 1001), ["review_summary:too_long"]),
        (_note(**{many: "x"}), [f"{many}:not_a_list"]),
        (_note(**{many: ["x"] * 9}), [f"{many}:too_many_items"]),
        (_note(**{many: ["x", 1, "y" * 301]}), [f"{many}:item_not_text"]),
        (_note(**{many: ["y" * 301, 1]}), [f"{many}:item_too_long"]),
        (_note(**{many: ["x", None]}), [f"{many}:item_not_text"]),
        (_note(review_summary="Issue confirmed"), ["blocked_terms"]),
        (_note().replace("Look", "\\u0043ertified"), ["blocked_terms"]),
    ]
    df = spark.createDataFrame(
        [(i, text) for i, (text, _) in enumerate(cases)], "i int, note string"
    )
    checked = notes.validate_notes(df, "note")
    for row in checked.collect():
        text, expected = cases[row.i]
        assert row.error_codes == expected, text
        assert row.notes_valid == (not expected)
        assert row.note == (text if row.notes_valid else None)
    counts = {r.error_code: r.rows_affected for r in notes.error_counts(checked).collect()}
    assert counts["none"] == 2 and counts["not_json"] == 2


def _broken_cells(draw, many):
    """Rows of (number, text) with line breaks, quotes and blank cells."""
    parts = ["x", "\n", '"', ",", "", "word ", "\n\n", "ü", "end\n"]
    return [(i, "".join(draw.choices(parts, k=draw.randint(0, 9)))) for i in range(many)]


def test_csv_with_line_breaks_is_split(spark, tmp_path):
    import csv
    import random

    draw = random.Random(6)
    folder = tmp_path / "many.csv"
    folder.mkdir()
    for name in ("one", "two", "three"):
        with open(folder / f"{name}.csv", "w", newline="") as out:
            writer = csv.writer(out, lineterminator="\n")
            writer.writerow(["number", "the\ntext", "last"])
            for number, text in _broken_cells(draw, 1_500):
                writer.writerow([number, text, f"{name}\n" * (number % 3 == 0)])
            writer.writerow([-1, "long\n" * 3_000, name])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        split = read_csv(spark, str(folder), "t", multiline="split")
        assert spark.read.text(str(folder)).rdd.getNumPartitions() > 20
        found = sorted(map(repr, split.frame.collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    whole = read_csv(spark, str(folder), "t", multiline=True)
    assert split.names == whole.names == ("number", "the\ntext", "last")
    assert found == sorted(map(repr, whole.frame.collect())) and len(found) == 4_503


def test_split_csv_that_does_not_fit(spark, tmp_path):
    with pytest.raises(ValueError, match="odd number of quotes"):
        read_csv(spark, _csv(tmp_path, 'a,b\n1,"x\n2,y\n'), "t", multiline="split")
    with pytest.raises(ValueError, match="1 rows .* more cells"):
        read_csv(spark, _csv(tmp_path, 'a,b\n1,"x\ny"\n3,4,5\n'), "t", multiline="split")
    with pytest.raises(ValueError, match="no header"):
        read_csv(spark, _csv(tmp_path, ""), "t", multiline="split")
    empty = read_csv(spark, _csv(tmp_path, "a,b\n"), "t", multiline="split")
    assert empty.names == ("a", "b") and empty.frame.count() == 0
