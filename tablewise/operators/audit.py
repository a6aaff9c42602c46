"""Audits over dashboard specs.

Specs are JSON documents, one a row, read from any files (``spec_rows``); a
spec table has one row per widget (``dataset, dashboard_id, pos, id, type, x,
y, w, h, layout_columns, source, metric, dim_x, measure_y, category, value,
columns, aggregation, limit``), a profile table one row per column, with
``dataset`` where it holds several.  The checks run over any number of
dashboards and datasets at once: windows are per dashboard, joins carry no
hint, so Spark picks them by measured size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewise.functions import fixed_values as FV

SNAKE_ID = r"^[a-z][a-z0-9]*(?:_[a-z0-9]+)*$"
DASHBOARD = ["dataset", "dashboard_id"]

SPEC_JSON = (
    "dataset string, dashboard_id string, layout struct<columns:int>, widgets array<struct<"
    "id:string, type:string, position:struct<x:int,y:int,w:int,h:int>, data:struct<source:string,metric:string,x:string,y:string,"
    "category:string,value:string,columns:array<string>,aggregation:string,limit:int>>>"
)


def spec_rows(documents: DataFrame, column: str = "value") -> DataFrame:
    """The widgets of spec documents as rows; ``column`` has the JSON text of one dashboard.

    A document that is no JSON, or has no widgets, gives no row; a field that is
    missing or of another kind is null.
    """
    spec = documents.select(F.from_json(column, SPEC_JSON).alias("s")).select("s.dataset", "s.dashboard_id", "s.layout", F.posexplode("s.widgets").alias("pos", "w"))
    d = "w.data"
    return spec.select(
        "dataset", "dashboard_id", "pos", "w.id", "w.type", *[F.col(f"w.position.{c}").alias(c) for c in "xywh"],
        F.coalesce("layout.columns", F.lit(FV.LAYOUT_COLUMNS)).alias("layout_columns"), F.coalesce(f"{d}.source", F.lit("main")).alias("source"), f"{d}.metric",
        F.col(f"{d}.x").alias("dim_x"), F.col(f"{d}.y").alias("measure_y"), f"{d}.category", f"{d}.value", f"{d}.columns", f"{d}.aggregation", f"{d}.limit",
    )


def referenced_columns(spec: DataFrame) -> DataFrame:
    """(dataset, dashboard_id, pos, id, type, aggregation, role, column) for every column a widget names."""
    t = F.col("type")
    ref = lambda role, column: F.struct(F.lit(role).alias("role"), column.alias("column"))
    one = lambda *pairs: F.array(*[ref(role, F.col(c)) for role, c in pairs])
    refs = (
        F.when(t.isin("kpi_card", "filter"), one(("metric", "metric")))
        .when(t.isin("bar_chart", "line_chart"), one(("x", "dim_x"), ("y", "measure_y")))
        .when(t == "pie_chart", one(("category", "category"), ("value", "value")))
        .when(t == "data_table", F.transform(F.coalesce("columns", F.array().cast("array<string>")), lambda c: ref("columns", c)))
    )
    return spec.select(*DASHBOARD, "pos", "id", "type", "aggregation", F.explode(refs).alias("r")).select(
        *DASHBOARD, "pos", "id", "type", "aggregation", "r.role", "r.column"
    ).where(F.col("column").isNotNull())


def _keys(prof: DataFrame) -> list[str]:
    return [*(["dataset"] if "dataset" in prof.columns else []), "column"]


def unknown_columns(spec: DataFrame, prof: DataFrame) -> DataFrame:
    """Widget references to columns that the profile of their dataset does not have (anti join)."""
    names = prof.withColumn("column", F.col("name")).select(*_keys(prof))
    return referenced_columns(spec).drop("aggregation").join(names, _keys(prof), "left_anti")


def _kinds(prof: DataFrame) -> DataFrame:
    sem = F.lower(F.coalesce(F.col("semantic_type"), F.col("semantic_role")))
    typ = F.lower(F.coalesce(F.col("type"), F.col("detected_type")))
    either = lambda roles, types: F.coalesce(sem.isin(*roles), F.lit(False)) | F.coalesce(typ.isin(*types), F.lit(False))
    return prof.withColumn("column", F.col("name")).select(
        *_keys(prof),
        either(["measure"], ["number", "currency"]).alias("is_numeric"),
        either(["date", "datetime"], ["date", "datetime"]).alias("is_date"),
        either(["dimension", "attribute", "identifier"], ["category", "text", "identifier", "boolean"]).alias("is_categorical"),
    )


def type_violations(spec: DataFrame, prof: DataFrame) -> DataFrame:
    """A metric must be numeric (unless counted), a bar x categorical or date,
    a line x date or ordered, a pie category categorical, a pie value numeric.

    A widget without an aggregation does not count, so it needs numbers.
    """
    k = referenced_columns(spec).join(_kinds(prof), _keys(prof))
    t, role = F.col("type"), F.col("role")
    counted = F.col("aggregation").eqNullSafe("count")
    numeric, date, categorical = F.col("is_numeric"), F.col("is_date"), F.col("is_categorical")
    rules = [
        ("kpi_card", "metric", ~counted & ~numeric, "metric_not_numeric"),
        ("bar_chart", "x", ~(categorical | date), "x_not_categorical"),
        ("bar_chart", "y", ~counted & ~numeric, "y_not_numeric"),
        ("line_chart", "x", ~(date | numeric), "x_not_ordered"),
        ("line_chart", "y", ~numeric, "y_not_numeric"),
        ("pie_chart", "category", ~categorical, "category_not_categorical"),
        ("pie_chart", "value", ~numeric, "value_not_numeric"),
    ]
    problem = F.coalesce(*[F.when((t == kind) & (role == part) & broken, F.lit(name)) for kind, part, broken, name in rules])
    return k.select(*DASHBOARD, "pos", "id", "type", "role", "column", problem.alias("problem")).where(F.col("problem").isNotNull())


def layout_violations(spec: DataFrame) -> DataFrame:
    """An id that a widget before has, ids not in snake_case, x + w past the grid."""
    same = Window.partitionBy(*DASHBOARD, F.coalesce("id", F.lit(""))).orderBy("pos")  # one dashboard's widgets
    problems = F.filter(
        F.array(
            F.when(F.row_number().over(same) > 1, F.lit("duplicate_id")),
            F.when(~F.coalesce(F.col("id"), F.lit("")).rlike(SNAKE_ID), F.lit("id_not_snake_case")),
            F.when(F.col("x") + F.col("w") > F.col("layout_columns"), F.lit("grid_overflow")),
        ),
        lambda x: x.isNotNull(),
    )
    return spec.withColumn("problems", problems).select(*DASHBOARD, "pos", "id", F.explode("problems").alias("problem"))


def signature() -> Column:
    """W5 analytical signature; null for filter and table widgets."""
    t = F.col("type")
    part = lambda *columns: F.coalesce(*[F.col(c) for c in columns], F.lit(""))
    how = [F.coalesce("source", F.lit("main"))], [F.coalesce("aggregation", F.lit("sum"))]
    joined = lambda kind, *parts: F.concat_ws("|", F.lit(kind), *how[0], *parts, *how[1])
    return (
        F.when(t == "kpi_card", joined("kpi", part("metric")))
        .when(t.isin("bar_chart", "pie_chart"), joined("chart", part("dim_x", "category"), part("measure_y", "value")))
        .when(t == "line_chart", joined("chart", part("dim_x"), part("measure_y")))
    )


def duplicate_analyses(spec: DataFrame) -> DataFrame:
    """Widgets whose signature repeats in a dashboard; ``keep`` marks the preferred one (line > bar = kpi > pie, then position)."""
    prio = F.create_map(*[F.lit(x) for kv in FV.WIDGET_PRIORITY.items() for x in kv])
    s = spec.withColumn("signature", signature()).where(F.col("signature").isNotNull())
    w = Window.partitionBy(*DASHBOARD, "signature")  # one dashboard's widgets
    best = F.row_number().over(w.orderBy(F.desc(F.coalesce(prio[F.col("type")], F.lit(0))), F.asc("pos")))
    s = s.withColumns({"n": F.count(F.lit(1)).over(w), "keep": best == 1}).where(F.col("n") > 1)
    return s.select(*DASHBOARD, "pos", "id", "type", "signature", "keep")
