"""Run log (U4), aggregate legality (I8), safe measures (I9), dimension rule (M5)."""
import datetime

from pyspark.sql import functions as F

from tablewise.operators import catalog as C
from tablewise.operators import profile as PR
from tablewise.operators import warehouse as W
from tablewise.session import shared_path


def test_run_log_durations(spark):
    path = shared_path(spark, "runlog")
    t0 = datetime.datetime(2024, 1, 1, 10, 0, 0)
    C.log_step(spark, path, "r1", "extract", "Success", t0, t0 + datetime.timedelta(seconds=5), "ok")
    C.log_step(spark, path, "r1", "clean", "Failed", t0, t0 + datetime.timedelta(seconds=2), "bad file")
    rows = {r["step"]: r for r in C.run_durations(spark.read.parquet(path)).collect()}
    assert rows["extract"]["duration_s"] == 5 and rows["clean"]["status"] == "Failed"


def test_aggregate_legality(spark):
    rows = [(i, n, r, t) for i, (n, r, t) in enumerate([("m", "Measure", "Number"), ("c", "Dimension", "Category"), ("k", "Identifier", "Identifier"), ("d", "Measure", "Date"), ("x", None, "Text")])]
    prof = spark.createDataFrame(rows, "position int, name string, semantic_role string, detected_type string")
    found = {(r["name"], r["calculation"]): r["reason"] for r in PR.legal_calculations(prof).collect()}
    assert len(found) == 30 and found[("m", "Total")] is None and found[("c", "Total")] == "not_a_measure"
    assert found[("k", "Nombre unique")] is None and found[("k", "Maximum")] == "not_a_measure"
    assert found[("d", "Moyenne")] == "date_not_summable" and found[("d", "Minimum")] is None
    assert found[("x", "Total")] == "not_a_measure" and found[("x", "Nombre")] is None


def test_guessed_roles(spark):
    rows = [("hire_date", "Hire date", False, False, False), ("client_id", "Client", False, True, False), ("amount", "Amount", False, True, False),
            ("kind", "Kind", False, False, True), ("day", "Day", True, False, False), ("note", None, False, False, False)]
    df = spark.createDataFrame(rows, "name string, label string, d boolean, n boolean, c boolean")
    role = PR.guessed_role(*[F.col(c) for c in df.columns])
    assert [r[0] for r in df.select(role).collect()] == ["Date Dimension", "Identifier", "Measure", "Dimension", "Date Dimension", "Attribute"]


def test_mappings_do_not_mix(spark):
    prof = spark.createDataFrame([("Amount", "amount", "Number"), ("Town", "town", "Category")], "original_name string, name string, detected_type string")
    columns = "mapping_id string, original_name string, normalized_name string, detected_type string, semantic_role string, aggregation string, include boolean"
    good = [(m, "Amount", "amount", None, "Measure", "sum", True) for m in ("a", "b")]
    assert PR.mapping_violations(PR.complete_mapping(spark.createDataFrame(good, columns), prof), prof).count() == 0
    assert PR.complete_mapping(spark.createDataFrame(good, columns), prof).count() == 4
    bad = [("c", "Amount", "amount", None, None, "sum", True), ("c", "Amount", "amount", "Number", "Identifier", "sum", True), ("d", None, None, None, "Measure", "mode", True)]
    found = sorted(map(tuple, PR.mapping_violations(spark.createDataFrame(good + bad, columns), prof).collect()), key=repr)
    assert found == sorted([
        ("c", "amount", "duplicate_column"), ("c", "amount", "duplicate_column"), ("c", "amount", "invalid_role"), ("c", "amount", "identifier_summed"),
        ("d", None, "unknown_column"), ("d", None, "invalid_type"), ("d", None, "invalid_aggregation"), ("d", None, "measure_not_numeric"),
    ], key=repr)


def test_admin_summary_of_tables(spark):
    jobs = spark.createDataFrame([("u1", "2024-01-05", 1), ("u2", "2024-01-04", 2), ("u2", "2023-12-01", 3), (None, None, 4)], "owner string, at string, id int").withColumn("at", F.col("at").cast("date"))
    refs = spark.createDataFrame([(1,), (1,), (None,), (9,)], "job int")
    found = {r["table"]: r.asDict() for r in C.admin_summary({"jobs": C.Catalog(jobs, "owner", "at", "id", refs, "job"), "refs": C.Catalog(refs)}, "2024-01-05").collect()}
    jobs_row = found["jobs"]
    assert (jobs_row["total"], jobs_row["top_owner"], jobs_row["top_owner_total"], jobs_row["top_owner_percentage"]) == (4, "u2", 2, 50.0)
    assert (jobs_row["today"], jobs_row["this_week"], jobs_row["this_month"], jobs_row["peak_day"]) == (1, 2, 2, "2023-12-01")
    assert (jobs_row["used"], jobs_row["unused"], jobs_row["usage_percentage"]) == (2, 2, 50.0)
    assert found["refs"]["total"] == 4 and found["refs"]["top_owner"] is None and found["refs"]["used"] is None


def test_safe_measures_and_dimension_rule(spark):
    df = spark.createDataFrame(
        [(i, float(i) * 2.5, ["a", "b", "c"][i % 3], f"name {i}") for i in range(60)],
        "order_id long, amount double, segment string, note string",
    )
    prof = PR.profile(df, order_by=["order_id"])
    safe = {r["name"] for r in PR.safe_measures(prof).collect()}
    assert safe == {"amount"}
    cats, dates, measures = W.dimension_columns(prof)
    assert "segment" in cats and "amount" in measures and not dates


def test_usage_rate_and_anti_join(spark):
    cat = spark.createDataFrame([(i,) for i in range(10)], "k long")
    use = spark.createDataFrame([(1,), (1,), (2,), (None,)], "ref long")
    r = C.usage_rate(cat, "k", use, "ref").collect()[0]
    assert (r["total"], r["used"], r["unused"], r["percentage"]) == (10, 2, 8, 20.0)
    assert C.without_reference(cat, "k", use, "ref").count() == 8
    flagged = {x["k"]: x["is_favorite"] for x in C.flag_referenced(cat, "k", use, "ref").collect()}
    assert flagged[1] and not flagged[3]
    assert C.natural_key(F.lit("Item 10")) is not None
