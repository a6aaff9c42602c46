"""Registered audits over spec documents.

A dashboard of eight widgets is made of every eight events, written as JSON
lines and read back, so the audited specs are a table that grows with the
data.  Two datasets share their column names but not the columns' kinds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.functions import fixed_values as FV
from tablewise.operators import audit as AU
from tablewise.operators import profile as PR
from tablewise.plans.registered import _profile_sql, _sql_list, _t, register
from tablewise.session import shared_path

_WIDGETS = 8
_TYPES = FV.WIDGET_TYPES
_AGGREGATIONS = [None, "sum", "count", "avg"]
_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority", "ghost_column"]


def _picked(values: list[str | None], index):
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (F.pmod(index, F.lit(len(values))) + 1).cast("int"))


def spec_documents(spark, sf) -> DataFrame:
    """One JSON document for each dashboard, from files of JSON lines."""
    k, user = F.col("event_id"), F.col("user_id")
    a, b = _picked(_COLUMNS, user), _picked(_COLUMNS, F.floor(user / 7) + k)
    kind = _picked(_TYPES, k)
    only = lambda column, *kinds: F.when(kind.isin(*kinds), column)
    data = F.struct(
        only(a, "kpi_card", "filter").alias("metric"), only(a, "bar_chart", "line_chart").alias("x"), only(b, "bar_chart", "line_chart").alias("y"),
        only(a, "pie_chart").alias("category"), only(b, "pie_chart").alias("value"), F.when(kind == "data_table", F.array(a, b)).alias("columns"),
        _picked(_AGGREGATIONS, F.floor(k / 6)).alias("aggregation"),
    )
    name = F.when(k % 5 == 0, F.concat(F.lit("W"), k)).when(k % 5 == 1, F.lit("same_widget")).otherwise(F.concat(F.lit("w_"), k))
    widget = F.struct(k.alias("k"), name.alias("id"), kind.alias("type"), F.struct((k * 3 % 15).alias("x"), F.lit(0).alias("y"), (3 + k % 4).alias("w"), F.lit(2).alias("h")).alias("position"), data.alias("data"))
    dashboards = _t(spark, sf, "events").select(F.floor(k / _WIDGETS).alias("d"), widget.alias("w")).groupBy("d").agg(F.sort_array(F.collect_list("w")).alias("widgets"))  # eight a group
    dataset = F.when(F.col("d") % 2 == 0, F.lit("orders")).otherwise(F.lit("orders_swapped"))
    path = shared_path(spark, "specs")
    dashboards.select(F.to_json(F.struct(dataset.alias("dataset"), F.concat(F.lit("d"), "d").alias("dashboard_id"), "widgets"))).write.text(path)
    return spark.read.text(path)


def _specs(spark, sf) -> DataFrame:
    return AU.spec_rows(spec_documents(spark, sf))


def _profiles(spark, sf) -> DataFrame:
    """Profiles of orders and of orders with the price and the priority swapped."""
    o = _t(spark, sf, "orders")
    swapped = o.select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_orderpriority").alias("o_totalprice"), "o_orderdate", F.col("o_totalprice").alias("o_orderpriority"))
    found = [PR.modern_profile(PR.profile(df, order_by=["o_orderkey"], most_frequent=False)).withColumn("dataset", F.lit(name)) for name, df in (("orders", o), ("orders_swapped", swapped))]
    return found[0].unionByName(found[1])


_COLUMNS_SQL = [("o_orderkey", "integral"), ("o_custkey", "integral"), ("o_orderstatus", "text"), ("o_totalprice", "number"), ("o_orderdate", "temporal"), ("o_orderpriority", "text")]
_SWAPPED_SQL = [(c, {"o_totalprice": "text", "o_orderpriority": "number"}.get(c, k)) for c, k in _COLUMNS_SQL]
_SWAPPED = "(SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority AS o_totalprice, o_orderdate, o_totalprice AS o_orderpriority FROM orders)"

_SPEC_SQL = f"""
    e AS (SELECT event_id AS k, event_id // {_WIDGETS} AS d, row_number() OVER (PARTITION BY event_id // {_WIDGETS} ORDER BY event_id) - 1 AS pos,
                 [{_sql_list(_TYPES)}][1 + event_id % {len(_TYPES)}] AS type, [NULL, 'sum', 'count', 'avg'][1 + (event_id // 6) % 4] AS aggregation,
                 [{_sql_list(_COLUMNS)}][1 + user_id % {len(_COLUMNS)}] AS a, [{_sql_list(_COLUMNS)}][1 + (user_id // 7 + event_id) % {len(_COLUMNS)}] AS b FROM events),
    spec AS (SELECT CASE WHEN d % 2 = 0 THEN 'orders' ELSE 'orders_swapped' END AS dataset, 'd' || d AS dashboard_id, CAST(pos AS INTEGER) AS pos,
                    CASE k % 5 WHEN 0 THEN 'W' || k WHEN 1 THEN 'same_widget' ELSE 'w_' || k END AS id, type, aggregation, a, b, k * 3 % 15 AS x, 3 + k % 4 AS w FROM e),
    refs AS (SELECT dataset, dashboard_id, pos, id, type, aggregation, CASE WHEN type IN ('kpi_card', 'filter') THEN 'metric' WHEN type = 'pie_chart' THEN 'category' WHEN type = 'data_table' THEN 'columns' ELSE 'x' END AS role, a AS "column" FROM spec
             UNION ALL SELECT dataset, dashboard_id, pos, id, type, aggregation, CASE WHEN type = 'pie_chart' THEN 'value' WHEN type = 'data_table' THEN 'columns' ELSE 'y' END, b FROM spec WHERE type NOT IN ('kpi_card', 'filter'))
"""


@register(
    "audit_unknown_columns",
    f"""WITH {_SPEC_SQL} SELECT dataset, dashboard_id, pos, id, type, role, "column" FROM refs WHERE "column" = 'ghost_column'""",
)
def audit_unknown_columns(spark, sf):
    """References to columns that the dashboard's dataset does not have."""
    return AU.unknown_columns(_specs(spark, sf), _profiles(spark, sf))


@register(
    "audit_type_rules",
    f"""
    WITH {_SPEC_SQL},
    p AS (SELECT 'orders' AS dataset, * FROM ({_profile_sql("orders", _COLUMNS_SQL, "o_orderkey")})
          UNION ALL SELECT 'orders_swapped', * FROM ({_profile_sql(_SWAPPED, _SWAPPED_SQL, "o_orderkey")})),
    kinds AS (SELECT dataset, name AS "column", semantic_role = 'Measure' OR detected_type IN ('Number', 'Currency') AS is_numeric,
                     semantic_role = 'Date Dimension' OR detected_type = 'Date' AS is_date,
                     semantic_role IN ('Dimension', 'Attribute', 'Identifier') OR detected_type IN ('Category', 'Text', 'Identifier', 'Boolean') AS is_categorical FROM p),
    v AS (SELECT refs.*, CASE
            WHEN type = 'kpi_card' AND coalesce(aggregation, '') <> 'count' AND NOT is_numeric THEN 'metric_not_numeric'
            WHEN type = 'bar_chart' AND role = 'x' AND NOT (is_categorical OR is_date) THEN 'x_not_categorical'
            WHEN type = 'bar_chart' AND role = 'y' AND coalesce(aggregation, '') <> 'count' AND NOT is_numeric THEN 'y_not_numeric'
            WHEN type = 'line_chart' AND role = 'x' AND NOT (is_date OR is_numeric) THEN 'x_not_ordered'
            WHEN type = 'line_chart' AND role = 'y' AND NOT is_numeric THEN 'y_not_numeric'
            WHEN type = 'pie_chart' AND role = 'category' AND NOT is_categorical THEN 'category_not_categorical'
            WHEN type = 'pie_chart' AND role = 'value' AND NOT is_numeric THEN 'value_not_numeric' END AS problem
          FROM refs JOIN kinds USING (dataset, "column"))
    SELECT dataset, dashboard_id, pos, id, type, role, "column", problem FROM v WHERE problem IS NOT NULL
    """,
)
def audit_type_rules(spark, sf):
    """W3 over two datasets that share column names, widgets without an aggregation included."""
    return AU.type_violations(_specs(spark, sf), _profiles(spark, sf))


@register(
    "audit_layout",
    f"""
    WITH {_SPEC_SQL}
    SELECT dataset, dashboard_id, pos, id, 'duplicate_id' AS problem FROM spec QUALIFY row_number() OVER (PARTITION BY dashboard_id, id ORDER BY pos) > 1
    UNION ALL SELECT dataset, dashboard_id, pos, id, 'id_not_snake_case' FROM spec WHERE NOT regexp_full_match(id, '[a-z][a-z0-9]*(?:_[a-z0-9]+)*')
    UNION ALL SELECT dataset, dashboard_id, pos, id, 'grid_overflow' FROM spec WHERE x + w > {FV.LAYOUT_COLUMNS}
    """,
)
def audit_layout(spark, sf):
    """Repeated ids, ids not in snake_case, widgets past the grid."""
    return AU.layout_violations(_specs(spark, sf))


@register(
    "audit_duplicate_analyses",
    f"""
    WITH {_SPEC_SQL},
    s AS (SELECT *, CASE WHEN type = 'kpi_card' THEN 'kpi|main|' || a || '|' ELSE 'chart|main|' || a || '|' || b || '|' END || coalesce(aggregation, 'sum') AS signature,
                 CASE type WHEN 'line_chart' THEN 4 WHEN 'pie_chart' THEN 1 ELSE 3 END AS prio
          FROM spec WHERE type NOT IN ('filter', 'data_table'))
    SELECT dataset, dashboard_id, pos, id, type, signature, row_number() OVER w = 1 AS keep FROM s
    WINDOW w AS (PARTITION BY dashboard_id, signature ORDER BY prio DESC, pos)
    QUALIFY count(*) OVER (PARTITION BY dashboard_id, signature) > 1
    """,
)
def audit_duplicate_analyses(spark, sf):
    """Widgets that analyse the same thing, and which of them to keep."""
    return AU.duplicate_analyses(_specs(spark, sf))
