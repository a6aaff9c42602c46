"""Dashboard queries, W1 execution, W2–W5 audits, W9 default spec."""
from pyspark.sql import functions as F

from tablewise.functions import names as N
from tablewise.operators import audit as AU
from tablewise.operators import clean as CL
from tablewise.operators import profile as PR
from tablewise.operators import query as Q
from tablewise.plans import dashboard as D


def _clean(employees):
    renamed, mapping, labels = N.rename_readable(employees)
    clean, _ = CL.clean_dataset(renamed)
    return clean, mapping, labels


def test_kpi_and_bar(employees):
    clean, _, _ = _clean(employees)
    k = Q.kpis(clean, [("n", "employee_id", "count"), ("total", "monthly_salary", "sum"), ("rows", None, "count")]).collect()[0]
    assert k["n"] == 5 and k["total"] == 20500.5 and k["rows"] == 5
    bar = [(r["label"], r["value"]) for r in Q.grouped_chart(clean, "department", "monthly_salary", "sum").collect()]
    assert bar == [("Engineering", 10600.5), ("Sales", 7000.0), ("HR", 2900.0)]
    line = [(r["label"], r["value"]) for r in Q.monthly_series(clean, "start_date", "monthly_salary", "sum").collect()]
    assert line == [("2022-03", 2900.0), ("2023-09", 5500.0), ("2023-11", 5100.5), ("2024-01", 3200.0), ("2024-06", 3800.0)]


def test_histogram_edges(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("v"))
    h = Q.histogram(df, "v").collect()
    assert len(h) == 10 and sum(r["count"] for r in h) == 100 and h[-1]["bin_hi"] == 99.0
    one = Q.histogram(spark.range(3).select(F.lit(5.0).alias("v")), "v").collect()
    assert len(one) == 1 and one[0]["count"] == 3


def _spec():
    return {"widgets": [
        {"id": "employee_count", "type": "kpi_card", "data": {"metric": "employee_id", "aggregation": "count"}},
        {"id": "salary_by_dept", "type": "bar_chart", "data": {"x": "department", "y": "monthly_salary", "aggregation": "sum"}},
        {"id": "salary_trend", "type": "line_chart", "data": {"x": "start_date", "y": "monthly_salary", "aggregation": "sum"}},
        {"id": "gender_share", "type": "pie_chart", "data": {"category": "gender", "value": "monthly_salary", "aggregation": "count"}},
        {"id": "dept_filter", "type": "filter", "data": {"metric": "department"}},
        {"id": "details", "type": "data_table", "data": {"columns": ["employee_id", "ghost"], "limit": 3}},
        {"id": "ghost_chart", "type": "bar_chart", "data": {"x": "ghost_column", "y": "monthly_salary"}},
    ]}


def test_run_dashboard(employees):
    clean, _, _ = _clean(employees)
    long, tables = D.run_dashboard(clean, _spec(), ["employee_id"])
    rows = long.collect()
    by = {}
    for r in rows:
        by.setdefault(r["widget_id"], []).append(r)
    assert by["employee_count"][0]["value"] == 5
    assert [(r["label"], r["value"]) for r in sorted(by["salary_by_dept"], key=lambda r: r["rank"])][0] == ("Engineering", 10600.5)
    assert len(by["salary_trend"]) == 5
    assert {r["label"]: r["value"] for r in by["gender_share"]} == {"M": 3, "F": 2}
    assert {r["label"] for r in by["dept_filter"]} == {"Engineering", "Sales", "HR"}
    assert by["ghost_chart"][0]["error"] == "invalid grouping"
    assert tables["details"].columns == ["employee_id"] and tables["details"].count() == 3


def test_dashboard_is_one_scan(employees, tmp_path):
    clean, _, _ = _clean(employees)
    path = str(tmp_path / "emp")
    clean.write.parquet(path)
    df = clean.sparkSession.read.parquet(path)
    spec = {"widgets": [w for w in _spec()["widgets"] if w["type"] != "line_chart"]}
    long, _ = D.run_dashboard(df, spec)
    long.collect()
    plan = long._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan") == 1
    assert "Expand" in plan and "WindowGroupLimit" in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_default_dashboard_and_audits(spark, employees):
    clean, mapping, labels = _clean(employees)
    prof = PR.profile(clean, {v: k for k, v in mapping.items()}, labels)
    spec = D.default_dashboard(PR.schema_from_profile(prof), {"main_metric": "Salaire mensuel"})
    types = [w["type"] for w in spec["widgets"]]
    assert types == ["kpi_card", "bar_chart", "line_chart", "pie_chart", "data_table"]
    assert spec["widgets"][0]["data"]["metric"] == "monthly_salary"

    widgets = {"widgets": [
        {"id": "total_salary", "type": "kpi_card", "position": {"x": 0, "y": 0, "w": 3, "h": 2}, "data": {"metric": "monthly_salary", "aggregation": "sum"}},
        {"id": "total_salary", "type": "kpi_card", "position": {"x": 3, "y": 0, "w": 3, "h": 2}, "data": {"metric": "ghost_column", "aggregation": "sum"}},
        {"id": "EmployeeCount", "type": "kpi_card", "position": {"x": 10, "y": 0, "w": 3, "h": 2}, "data": {"metric": "department", "aggregation": "sum"}},
        {"id": "bar_a", "type": "bar_chart", "position": {"x": 0, "y": 2, "w": 6, "h": 4}, "data": {"x": "department", "y": "monthly_salary", "aggregation": "sum"}},
        {"id": "pie_a", "type": "pie_chart", "position": {"x": 6, "y": 2, "w": 6, "h": 4}, "data": {"category": "department", "value": "monthly_salary", "aggregation": "sum"}},
        {"id": "filter_a", "type": "filter", "position": {"x": 0, "y": 6, "w": 3, "h": 1}, "data": {"metric": "department"}},
        {"id": "filter_b", "type": "filter", "position": {"x": 3, "y": 6, "w": 3, "h": 1}, "data": {"metric": "department"}},
    ]}
    st = D.spec_table(spark, widgets)
    assert {r["column"] for r in AU.unknown_columns(st, prof).collect()} == {"ghost_column"}
    assert {(r["id"], r["problem"]) for r in AU.type_violations(st, PR.modern_profile(prof)).collect()} == {("EmployeeCount", "metric_not_numeric")}
    layout = {(r["pos"], r["problem"]) for r in AU.layout_violations(st).collect()}
    assert (1, "duplicate_id") in layout and (2, "id_not_snake_case") in layout and (2, "grid_overflow") in layout
    dup = {r["id"]: r["keep"] for r in AU.duplicate_analyses(st).collect()}
    assert dup == {"bar_a": True, "pie_a": False}


def test_line_chart_on_raw_key(spark):
    df = spark.createDataFrame([(i % 37, float(i)) for i in range(500)], "k long, v double")
    spec = {"widgets": [
        {"id": "by_k", "type": "line_chart", "data": {"x": "k", "y": "v", "aggregation": "count"}},
        {"id": "top_k", "type": "bar_chart", "data": {"x": "k", "y": "v", "aggregation": "sum", "limit": 3}},
    ]}
    rows = D.run_dashboard(df, spec)[0].collect()
    line = sorted((r["rank"], r["label"]) for r in rows if r["widget_id"] == "by_k")
    assert [r for r, _ in line] == list(range(1, 38))
    assert [lbl for _, lbl in line] == sorted(str(k) for k in range(37))
    assert len([r for r in rows if r["widget_id"] == "top_k"]) == 3
