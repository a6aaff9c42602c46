"""Cleaning, profiling and quality on the reference-shaped fixtures."""
import datetime

from pyspark.sql import functions as F

from tablewise.functions import names as N
from tablewise.operators import clean as CL
from tablewise.operators import profile as PR
from tablewise.operators import quality as QL


def _cleaned(employees):
    renamed, mapping, labels = N.rename_readable(employees)
    clean, report = CL.clean_dataset(renamed)
    return clean, report, mapping, labels


def test_clean_salaries_and_dates(employees):
    clean, report, _, _ = _cleaned(employees)
    rows = {r["employee_id"]: r for r in clean.collect()}
    assert [rows[k]["monthly_salary"] for k in sorted(rows)] == [3200.0, 5500.0, 3800.0, 2900.0, 5100.5]
    assert rows["E001"]["start_date"] == datetime.datetime(2024, 1, 15)
    assert "monthly_salary" in report.numeric_columns and "start_date" in report.date_columns
    assert report.duplicate_rows_removed == 0
    agg = clean.groupBy("department").agg(F.sum("monthly_salary").alias("s")).collect()
    assert {r["department"]: r["s"] for r in agg} == {"Engineering": 10600.5, "Sales": 7000.0, "HR": 2900.0}


def test_constant_and_duplicate_variants(employees):
    with_country = employees.withColumn("Country", F.lit("France"))
    doubled = with_country.unionByName(with_country.limit(1))
    clean, report = CL.clean_dataset(doubled)
    assert "Country" in clean.columns and report.constant_columns == ["Country"]
    assert report.duplicate_rows_removed == 1 and clean.count() == 5


def test_profile_roles(employees):
    clean, _, mapping, labels = _cleaned(employees)
    originals = {v: k for k, v in mapping.items()}
    prof = {r["name"]: r for r in PR.profile(clean, originals, labels, order_by=["employee_id"]).collect()}
    assert prof["employee_id"]["semantic_role"] == "Identifier"
    assert prof["monthly_salary"]["semantic_role"] == "Measure"
    assert prof["annual_salary"]["semantic_role"] == "Measure"
    assert prof["start_date"]["semantic_role"] == "Date Dimension"
    assert prof["gender"]["semantic_role"] in ("Dimension", "Attribute")
    assert prof["employee_name"]["semantic_role"] == "Attribute"
    assert prof["monthly_salary"]["label"] == "Salaire mensuel"
    assert prof["monthly_salary"]["aggregation"] == "sum"
    assert prof["employee_id"]["sample_values"] == ["E001", "E002", "E003", "E004", "E005"]


def test_profile_malformed(spark):
    df = spark.createDataFrame(
        [("1,200", "2024-01-01", "M"), (None, "not a date", "male"), ("bad", None, "Female")],
        "` Monthly Salary ` string, `Start Date` string, Gender string",
    )
    renamed, mapping, labels = N.rename_readable(df)
    assert renamed.columns[0] == "monthly_salary"
    prof = {r["name"]: r for r in PR.profile(renamed, {v: k for k, v in mapping.items()}).collect()}
    assert prof["monthly_salary"]["semantic_role"] == "Measure"
    assert prof["start_date"]["semantic_role"] == "Date Dimension"
    assert "partial_date_conversion" in prof["start_date"]["warnings"]
    score = QL.quality_score(renamed, {"monthly_salary": 1, "start_date": 1}, 0).collect()[0]["score"]
    assert score == 85.56


def test_profile_unusable_columns(spark):
    df = spark.createDataFrame(
        [(1001, None, "same", "x" * 130), (1002, None, "same", "y" * 140), (1003, None, "same", "z" * 150)],
        "`Customer ID` long, `Empty Column` string, Constant string, `Long Notes` string",
    )
    renamed, mapping, _ = N.rename_readable(df)
    prof = {r["name"]: r for r in PR.profile(renamed, {v: k for k, v in mapping.items()}).collect()}
    assert prof["customer_id"]["semantic_role"] == "Identifier"
    assert prof["empty_column"]["semantic_role"] == "Ignored" and "empty_column" in prof["empty_column"]["warnings"]
    assert prof["constant"]["semantic_role"] == "Ignored" and not prof["constant"]["include"]


def test_quality_drops_with_missing(employees):
    clean, report, _, _ = _cleaned(employees)
    full = QL.quality_score(clean).collect()[0]["score"]
    holes = clean.withColumn("monthly_salary", F.when(F.col("employee_id") > "E003", F.col("monthly_salary")))
    worse = QL.quality_score(holes).collect()[0]["score"]
    assert full == 100.0 and worse < full


def test_mapping_violations(employees):
    clean, _, mapping, _ = _cleaned(employees)
    prof = PR.profile(clean, {v: k for k, v in mapping.items()})
    m = PR.mapping_from_profile(prof).withColumn(
        "semantic_role", F.when(F.col("normalized_name") == "department", F.lit("Measure")).otherwise(F.col("semantic_role")))
    problems = {(r["normalized_name"], r["problem"]) for r in PR.mapping_violations(m, prof).collect()}
    assert ("department", "measure_not_numeric") in problems


def test_transform_rules(employees):
    out, warnings = CL.apply_rules(employees, [
        {"rule_type": "Normalize Category", "column_name": "Gender"},
        {"rule_type": "Drop Column", "column_name": "Annual Salary"},
        {"rule_type": "Rename Column", "column_name": "Name", "config": {"new_name": "full_name"}},
        {"rule_type": "Fill Missing", "column_name": "ghost", "config": {"value": 0}},
        {"rule_type": "Custom Formula", "column_name": "full_name"},
    ])
    assert "Annual Salary" not in out.columns and "full_name" in out.columns
    assert {r["Gender"] for r in out.collect()} == {"Male", "Female"}
    assert any("ghost" in w for w in warnings) and any("Custom Formula" in w for w in warnings)


def test_clean_plan_replays_decisions(employees):
    renamed, _, _ = N.rename_readable(employees)
    clean, report = CL.clean_dataset(renamed)
    replay = CL.clean_plan(renamed, report.numeric_columns, {c: True for c in report.date_columns}, report.removed_empty_columns)
    assert sorted(map(tuple, replay.collect())) == sorted(map(tuple, clean.collect()))
