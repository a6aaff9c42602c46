"""Inputs that used to lose data or give wrong answers."""
import datetime
import zipfile

import pytest
from pyspark.sql import functions as F

from tablewise.functions import parse as P
from tablewise.operators import catalog, clean, query
from tablewise.operators import audit
from tablewise.operators import profile as PR
from tablewise.operators.profile import column_stats
from tablewise.plans import dashboard
from tablewise.plans.dashboard import run_dashboard
from tablewise.session import shared_path
from tablewise.sources import tables, workbook

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def _workbook(path, rows):
    """One sheet; style 1 is a date. ``rows``: XML of the cells of each row."""
    body = "".join(f'<row r="{i}">{cells}</row>' for i, cells in enumerate(rows, 1))
    parts = {
        "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Data" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet xmlns="{MAIN}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{MAIN}"><sheetData>{body}</sheetData></worksheet>',
    }
    with zipfile.ZipFile(path, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)


def _t(ref, text):
    return f'<c r="{ref}" t="inlineStr"><is><t>{text}</t></is></c>'


@pytest.fixture()
def folder(tmp_path):
    _workbook(tmp_path / "a.xlsx", [
        _t("A1", "Name") + _t("B1", "Amount") + _t("C1", "Amount") + _t("E1", "When"),
        _t("A2", "x") + '<c r="B2"><v>1</v></c><c r="C2"><v>2</v></c><c r="D2"><v>3</v></c><c r="E2" s="1"><v>45306</v></c>',
        _t("A3", "y") + '<c r="B3" t="e"><v>#N/A</v></c><c r="C3" t="b"><v>1</v></c><c r="D3"><v>4</v></c><c r="E3" s="1"><v>45306.5</v></c>',
    ])
    _workbook(tmp_path / "b.xlsx", [_t("A1", "Name") + _t("B1", "City"), _t("A2", "z") + _t("B2", "Lyon")])
    return str(tmp_path)


def test_workbooks_keep_every_column_and_date(spark, folder):
    out = {r["Name"]: r for r in workbook.read_workbooks(spark, folder).collect()}
    assert (out["x"]["Amount"], out["x"]["Amount_2"], out["x"]["column_4"], out["x"]["When"]) == ("1", "2", "3", "2024-01-15")
    assert (out["y"]["Amount"], out["y"]["Amount_2"], out["y"]["When"]) == (None, "true", "2024-01-15 12:00:00")
    assert out["z"]["City"] == "Lyon" and out["z"]["Amount"] is None


def test_large_or_several_files_are_refused(spark, folder):
    with pytest.raises(ValueError, match="a.xlsx"):
        workbook.read_cells(spark, folder, max_bytes=10)
    with pytest.raises(ValueError, match="more than one"):
        workbook.read_workbook(spark, folder)


def test_day_and_month_order_is_one_per_column(spark):
    rows = [("01/02/2024",), ("01/13/2024",), ("03/25/2024",), ("02/03/2024",)]
    df = spark.createDataFrame(rows, "order_date string")
    want = [datetime.datetime(2024, m, d) for m, d in ((1, 2), (1, 13), (2, 3), (3, 25))]
    out, report = clean.clean_dataset(df)
    assert sorted(r[0] for r in out.collect()) == want and not report.conversion_errors
    assert sorted(r[0] for r in clean.legacy_clean(df)[0].collect()) == [w.date() for w in want]
    ruled, _ = clean.apply_rules(df, [{"rule_type": "Convert Date", "column_name": "order_date"}])
    assert sorted(r[0] for r in ruled.collect()) == [w.date() for w in want]
    months = {r["label"]: r["value"] for r in query.monthly_series(df, "order_date", None, "count").collect()}
    assert sum(months.values()) == 4 and len(months) == 3
    stats = column_stats(df).first()
    assert (stats["date_ok"], stats["date_min"], stats["date_max"]) == (4, want[0], want[3])
    assert P.date_orders(df, ["order_date"]) == {"order_date": False}


def test_long_digit_runs_sort_as_numbers(spark):
    texts = ["v" + "9" * 21, "v1" + "0" * 21, "v007", "v10"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    assert [r[0] for r in catalog.sorted_list(df, "s").collect()] == ["v007", "v10", "v" + "9" * 21, "v1" + "0" * 21]


def test_json_keeps_fractions(spark):
    df = spark.sql("select timestamp_ntz'2024-05-01 01:02:03.456' t union all select timestamp_ntz'2024-05-01 01:02:03'")
    path = shared_path(spark, "fractions")
    tables.write_json(df, path)
    assert sorted(r[0].microsecond for r in tables.read_json(spark, path, "t timestamp_ntz").collect()) == [0, 456000]


def test_filters_are_typed_and_reach_the_scan(spark):
    df = spark.createDataFrame([(5.0, True, 1), (6.0, False, 2)], "d double, b boolean, n int")
    assert query.apply_filters(df, [{"type": "select", "field": "d", "value": 5}]).count() == 1
    assert query.apply_filters(df, [{"type": "select", "field": "b", "value": "True"}]).count() == 1
    assert query.apply_filters(df, [{"type": "multi_select", "field": "n", "value": [2, 3]}]).count() == 1
    with pytest.raises(ValueError, match="ghost"):
        query.apply_filters(df, [{"type": "select", "field": "ghost", "value": 1}])
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    kept = query.apply_filters(orders, [{"type": "number_range", "field": "o_totalprice", "min": 10, "max": 1000}, {"type": "select", "field": "o_custkey", "value": 7}])
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_totalprice,10.0)" in plan and "EqualTo(o_custkey,7)" in plan


def test_every_widget_has_a_row(spark):
    kpi = lambda i, m, a: {"id": i, "type": "kpi_card", "data": {"metric": m, "aggregation": a}}
    spec = {"widgets": [kpi("a", "n", "sum"), kpi("b", "n", "count"), {"id": "l", "type": "line_chart", "data": {"x": "s", "y": "n", "aggregation": "sum"}}]}
    df = spark.createDataFrame([("p", 1.0), ("q", 2.0)], "s string, n double")
    full = {(r["widget_id"], r["label"]): r["value"] for r in run_dashboard(df, spec)[0].collect()}
    assert full[("l", "p")] == 1.0 and full[("l", "q")] == 2.0 and full[("a", "value")] == 3.0
    empty = {r["widget_id"]: r["value"] for r in run_dashboard(df.where(F.lit(False)), spec)[0].collect()}
    assert empty["a"] == 0.0 and empty["b"] == 0.0


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_profile_shuffles_no_whole_text(spark):
    long = ["x" * 200 + str(i % 3) for i in range(9)] + ["x" * 64, "x" * 65, "é" * 70, None, "short"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(long)], "id long, t string")
    counts = PR.cell_counts(df, ["t"], readings=True)
    assert "value" not in counts.columns and max(len(r["head"]) for r in counts.where("head is not null").collect()) == PR.HEAD
    below = _plan(counts).split("Exchange")[0]
    assert "groupBy" not in below and "value" not in "".join(line for line in _plan(counts).splitlines() if "Exchange" in line)
    top = [(r["value"], r["count"]) for r in PR.top_values(df, ["t"], 4).orderBy("rank").collect()]
    assert top == [("x" * 200 + d, 3) for d in "012"] + [("short", 1)]
    first = {r["name"]: r["firsts"] for r in PR.first_values(df, ["id", "t"], 11, ["id"]).collect()}
    assert first["t"] == [t for t in long if t is not None][:11] and first["id"] == [str(i) for i in range(11)]
    prof = {r["name"]: r for r in PR.profile(df, order_by=["id"]).collect()}
    assert prof["t"]["sample_values"] == long[:5] and prof["t"]["null_count"] == 1 and prof["t"]["unique_count"] == 7


def test_first_values_of_a_sparse_column(spark):
    df = spark.createDataFrame([(i, "v%d" % i if i % 50 == 49 else None) for i in range(1000)], "id long, s string")
    found = {r["name"]: r["firsts"] for r in PR.first_values(df, ["id", "s"], 5, ["id"]).collect()}
    assert found == {"id": list("01234"), "s": ["v49", "v99", "v149", "v199", "v249"]}


def test_cleaning_reads_its_input_once(spark, monkeypatch):
    path = shared_path(spark, "raw")
    rows = [("a", "1", None, ""), ("a", "1", None, ""), (" ", "", None, ""), (None, None, None, ""), (None, None, None, None), ("n/a", None, None, " "), ("b", "2", None, None)]
    spark.createDataFrame(rows, "s string, n string, e string, blank string").write.parquet(path)
    plans, kept = [], clean.checkpoint
    monkeypatch.setattr(clean, "checkpoint", lambda df: plans.append(_plan(df)) or kept(df))
    for materialize in (True, False):
        out, report = clean.clean_dataset(spark.read.parquet(path), materialize)
        got = sorted((tuple(r) for r in out.collect()), key=repr)
        assert got == [("a", 1.0), ("b", 2.0), (None, None)] and out.columns == ["s", "n"], materialize
        # two rows hold nothing in the columns that stay; the blank and the "n/a" row are one
        assert (report.rows_in, report.rows_out, report.duplicate_rows_removed) == (5, 3, 2)
        assert report.removed_empty_columns == ["e", "blank"]
    assert len(plans) == 1 and plans[0].count("FileScan") == 1
    none, report = clean.clean_dataset(spark.read.parquet(path).where(F.lit(False)))
    assert none.count() == 0 and report.rows_in == 0


def test_line_charts_over_text_dates_read_the_table_once(spark, monkeypatch):
    path = shared_path(spark, "text-dates")
    rows = [("01/02/2024", "2024-02-01", "p", 1.0), ("25/02/2024", "2024-02-25", "q", 2.0), ("03/03/2024", "2024-03-03", "p", None), (None, "soon", None, 4.0)]
    spark.createDataFrame(rows, "d string, i string, s string, v double").write.parquet(path)
    plans = []
    kept = dashboard.checkpoint
    monkeypatch.setattr(dashboard, "checkpoint", lambda df: plans.append(_plan(df)) or kept(df))
    line = lambda x, agg: {"id": x, "type": "line_chart", "data": {"x": x, "y": "v", "aggregation": agg}}
    spec = {"widgets": [line("d", "avg"), line("i", "sum"), line("s", "count"), {"id": "top", "type": "bar_chart", "data": {"x": "s", "y": "v", "aggregation": "sum"}}]}
    long = run_dashboard(spark.read.parquet(path), spec)[0]
    got = {(r["widget_id"], r["label"]): (r["value"], r["rank"]) for r in long.collect()}
    assert got[("d", "2024-02")] == (1.5, 1) and ("d", "2024-03") not in got
    assert got[("i", "2024-02")] == (3.0, 1) and got[("s", "p")] == (2.0, 2) and got[("s", "(vide)")] == (1.0, 1) and got[("top", "(vide)")] == (4.0, 1)
    assert len(plans) == 1 and plans[0].count("FileScan") == 1 and "FileScan" not in _plan(long)


def test_audits_tell_datasets_apart(spark):
    document = lambda dataset, agg: (
        '{"dataset": "%s", "dashboard_id": "d", "widgets": [{"id": "w", "type": "kpi_card", "data": {"metric": "amount"%s}}, {"id": "t", "type": "data_table", "data": {"columns": ["amount", "city"]}}]}'
        % (dataset, agg))
    texts = [document("sales", ""), document("people", ""), document("people", ', "aggregation": "count"').replace('"d"', '"e"'), "no json", '{"dataset": "x"}']
    specs = audit.spec_rows(spark.createDataFrame([(t,) for t in texts], "value string"))
    prof = spark.createDataFrame([("sales", "amount", "measure", "number"), ("people", "amount", "dimension", "text"), ("people", "city", "dimension", None)],
                                 "dataset string, name string, semantic_type string, type string").withColumns({"semantic_role": F.lit(None).cast("string"), "detected_type": F.lit(None).cast("string")})
    assert [(r["dataset"], r["column"]) for r in audit.unknown_columns(specs, prof).collect()] == [("sales", "city")]
    assert [(r["dataset"], r["dashboard_id"], r["problem"]) for r in audit.type_violations(specs, prof).collect()] == [("people", "d", "metric_not_numeric")]
    assert audit.layout_violations(specs).count() == 0 and audit.duplicate_analyses(specs).count() == 0


def test_workbooks_are_full_and_dealt_to_many_tasks(spark):
    n = 5 * workbook.FILES_PER_TASK * 4 + 3
    rows = spark.range(n, numPartitions=1).select(F.col("id").alias("Key"), F.when(F.col("id") % 7 != 0, F.lit("x")).alias("Mark"))
    made = workbook.to_workbooks(rows, title="List", rows_per_file=5)
    assert made.rdd.getNumPartitions() > 4  # one input partition does not mean one task
    assert sorted(r["rows"] for r in made.select("rows").collect()) == [3] + [5] * (n // 5)
    back = workbook.read_workbooks(spark, made).select("Key", "Mark").collect()
    assert sorted(map(tuple, back), key=repr) == sorted(((str(i), None if i % 7 == 0 else "x") for i in range(n)), key=repr)
    assert workbook.to_workbooks(rows.limit(0)).count() == 0
