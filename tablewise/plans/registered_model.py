"""Registered queries on profiles, rules, models and catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.functions import fixed_values as FV
from tablewise.functions import parse as P
from tablewise.operators import catalog as C
from tablewise.operators import profile as PR
from tablewise.operators import warehouse as W
from tablewise.plans import dashboard as D
from tablewise.plans import import_flow as IF
from tablewise.plans.registered import _CUSTOMER_PROFILE_SQL, _ORDERS_PROFILE_SQL, _dirty_customers, _orders_star, _sql_list, _t, register
from tablewise.session import sequential_id, shared_path
from tablewise.sources import tables as ST
from tablewise.sources import workbook as WBK


# ------------------------------------------------------------------ V2, V3, A9, A11
@register("row_ids_in_file_order", "SELECT event_id, row_number() OVER () AS source_row_id FROM events")
def row_ids_in_file_order(spark, sf):
    """V2 without an order key: ids follow the file; nothing is shuffled."""
    return sequential_id(_t(spark, sf, "events").select("event_id"), [], "source_row_id")


@register(
    "row_ids_of_repeated_keys",
    "SELECT event_id, row_number() OVER (ORDER BY event_type, event_id) AS source_row_id FROM events",
)
def row_ids_of_repeated_keys(spark, sf):
    """V2 on a key that many rows share: ties keep file order (events are filed by event_id)."""
    return sequential_id(_t(spark, sf, "events").select("event_id", "event_type"), ["event_type"], "source_row_id").drop("event_type")


@register(
    "first_values_in_file_order",
    """
    WITH r AS (SELECT *, row_number() OVER () AS o FROM pages),
         l AS (SELECT 'url' AS name, url AS value, o FROM r WHERE url IS NOT NULL AND trim(url) <> ''
               UNION ALL SELECT 'page_id', CAST(page_id AS VARCHAR), o FROM r WHERE page_id IS NOT NULL)
    SELECT name, string_agg(value, '|' ORDER BY o) AS firsts FROM (
      SELECT *, row_number() OVER (PARTITION BY name ORDER BY o) AS k FROM l) WHERE k <= 20 GROUP BY name
    """,
)
def first_values_in_file_order(spark, sf):
    """V3 without an order key: the first 20 values as the file holds them."""
    found = PR.first_values(_t(spark, sf, "pages"), ["url", "page_id"], 20)
    return found.select("name", F.array_join("firsts", "|").alias("firsts"))


@register(
    "top_values_of_long_texts",
    """
    WITH d AS (SELECT trim(text) AS v FROM documents),
         c AS (SELECT v, count(*) AS n FROM d WHERE v IS NOT NULL AND lower(v) NOT IN ({missing}) GROUP BY v)
    SELECT 'text' AS name, v AS value, n AS count, row_number() OVER (ORDER BY n DESC, v) AS rank FROM c QUALIFY rank <= 20
    """.format(missing=_sql_list(FV.MISSING_MARKERS)),
)
def top_values_of_long_texts(spark, sf):
    """A9 on whole documents: keys are shuffled, the texts of the result are fetched late."""
    return PR.top_values(_t(spark, sf, "documents"), ["text"], 20)


@register(
    "profile_of_large_numbers",
    """
    SELECT 'budget' AS name, CAST(min(v) AS VARCHAR) AS min_value, CAST(max(v) AS VARCHAR) AS max_value FROM (SELECT floor(o_totalprice) * 1000 + 0.5 AS v FROM orders)
    UNION ALL SELECT 'share', CAST(min(v) AS VARCHAR), CAST(max(v) AS VARCHAR) FROM (SELECT (1 + floor(o_totalprice)) / 1073741824 AS v FROM orders)
    """,
)
def profile_of_large_numbers(spark, sf):
    """Numbers print without an exponent from 0.0001 to 10^16."""
    o = _t(spark, sf, "orders").select((F.floor("o_totalprice") * 1000 + 0.5).alias("budget"), ((1 + F.floor("o_totalprice")) / F.lit(1073741824.0)).alias("share"))
    return PR.profile(o, order_by=["budget", "share"], most_frequent=False).select("name", "min_value", "max_value")


# ------------------------------------------------------------------ I7, I8, I9
@register(
    "mapping_violations_many",
    f"""
    WITH p AS ({_CUSTOMER_PROFILE_SQL}), ids AS (SELECT DISTINCT c_mktsegment AS mapping_id FROM customer),
    m AS (SELECT mapping_id, name, detected_type AS t,
                 CASE WHEN mapping_id = 'BUILDING' AND name = 'c_name' THEN 'Measure'
                      WHEN mapping_id = 'MACHINERY' AND name = 'c_acctbal' THEN NULL
                      WHEN mapping_id = 'FURNITURE' AND name = 'c_custkey' THEN 'Identifier' ELSE semantic_role END AS role,
                 CASE WHEN mapping_id = 'FURNITURE' AND name = 'c_custkey' THEN 'sum' ELSE aggregation END AS aggregation
          FROM p, ids)
    SELECT mapping_id, name AS normalized_name, 'invalid_role' AS problem FROM m WHERE role IS NULL
    UNION ALL SELECT mapping_id, name, 'measure_not_numeric' FROM m WHERE role = 'Measure' AND t NOT IN ('Number', 'Currency')
    UNION ALL SELECT mapping_id, name, 'date_dimension_not_date' FROM m WHERE role = 'Date Dimension' AND t <> 'Date'
    UNION ALL SELECT mapping_id, name, 'identifier_summed' FROM m WHERE role = 'Identifier' AND aggregation = 'sum'
    UNION ALL SELECT mapping_id, 'ghost', 'unknown_column' FROM ids WHERE mapping_id = 'HOUSEHOLD'
    UNION ALL SELECT mapping_id, 'ghost', 'invalid_type' FROM ids WHERE mapping_id = 'HOUSEHOLD'
    """,
)
def mapping_violations_many(spark, sf):
    """A mapping for each market segment, some edited badly, all naming the same columns."""
    c = _t(spark, sf, "customer")
    prof = PR.profile(c, order_by=["c_custkey"], most_frequent=False)
    proposed = PR.mapping_from_profile(prof).collect()  # one row a column
    listed = F.array(*[F.struct(*[F.lit(v).cast("boolean" if k == "include" else "string").alias(k) for k, v in r.asDict().items()]) for r in proposed])
    ids = c.select(F.col("c_mktsegment").alias("mapping_id")).distinct()
    m = ids.select("mapping_id", F.inline(listed))
    at = lambda segment, column: (F.col("mapping_id") == segment) & (F.col("normalized_name") == column)
    role = (
        F.when(at("BUILDING", "c_name"), F.lit("Measure")).when(at("MACHINERY", "c_acctbal"), F.lit(None).cast("string"))
        .when(at("FURNITURE", "c_custkey"), F.lit("Identifier")).otherwise(F.col("semantic_role"))
    )
    m = m.withColumns({"semantic_role": role, "aggregation": F.when(at("FURNITURE", "c_custkey"), F.lit("sum")).otherwise(F.col("aggregation"))})
    ghost = ids.where("mapping_id = 'HOUSEHOLD'").select(
        "mapping_id", F.lit("Ghost").alias("original_name"), F.lit("ghost").alias("normalized_name"), F.lit(None).cast("string").alias("detected_type"),
        F.lit("Attribute").alias("semantic_role"), F.lit(None).cast("string").alias("aggregation"), F.lit(True).alias("include"),
    )
    return PR.mapping_violations(PR.complete_mapping(m.unionByName(ghost), prof), prof)


@register(
    "legal_calculations_orders",
    f"""
    WITH p AS ({_ORDERS_PROFILE_SQL}),
    c AS (SELECT unnest([{_sql_list(FV.COUNTING_CALCULATIONS + FV.MEASURE_CALCULATIONS)}]) AS calculation)
    SELECT position, name, calculation,
           CASE WHEN calculation IN ({_sql_list(FV.COUNTING_CALCULATIONS)}) THEN NULL
                WHEN semantic_role <> 'Measure' THEN 'not_a_measure'
                WHEN calculation IN ('Total', 'Moyenne') AND detected_type = 'Date' THEN 'date_not_summable' END AS reason
    FROM p, c
    """,
)
def legal_calculations_orders(spark, sf):
    """I8: which calculation may run on which column of orders."""
    return PR.legal_calculations(PR.profile(_t(spark, sf, "orders"), order_by=["o_orderkey"], most_frequent=False))


@register(
    "guessed_roles_orders",
    f"""
    WITH p AS ({_ORDERS_PROFILE_SQL}),
    t AS (SELECT *, lower(name || ' ' || replace(name, '_', ' ')) AS txt FROM p)
    SELECT position, name,
           CASE WHEN detected_type = 'Date' OR contains(txt, 'date') OR contains(txt, 'start') OR contains(txt, 'end') OR contains(txt, 'joining') OR contains(txt, 'created') THEN 'Date Dimension'
                WHEN contains(txt, ' id') OR contains(txt, '_id') OR contains(txt, 'code') OR contains(txt, 'matricule') OR contains(txt, ' ref') THEN 'Identifier'
                WHEN detected_type IN ('Number', 'Currency') THEN 'Measure'
                WHEN detected_type IN ('Category', 'Boolean') THEN 'Dimension' ELSE 'Attribute' END AS role
    FROM t
    """,
)
def guessed_roles_orders(spark, sf):
    """I8: roles guessed where none is stored."""
    p = PR.profile(_t(spark, sf, "orders"), order_by=["o_orderkey"], most_frequent=False)
    t = F.col("detected_type")
    return p.select("position", "name", PR.guessed_role(F.col("name"), F.col("label"), t == "Date", t.isin("Number", "Currency"), t.isin("Category", "Boolean")).alias("role"))


@register(
    "safe_measures_orders",
    f"""
    WITH p AS ({_ORDERS_PROFILE_SQL})
    SELECT name FROM p WHERE semantic_role = 'Measure' AND detected_type IN ('Number', 'Currency')
      AND NOT ({" OR ".join(f"contains(lower(name || ' ' || replace(name, '_', ' ')), '{t}')" for t in FV.UNSAFE_MEASURE_TOKENS)})
    """,
)
def safe_measures_orders(spark, sf):
    """Measures that may be summed without a look at them."""
    return PR.safe_measures(PR.profile(_t(spark, sf, "orders"), order_by=["o_orderkey"], most_frequent=False)).select("name")


# ------------------------------------------------------------------ M4, S12
def _flat(manifest: DataFrame) -> DataFrame:
    lists = ["columns", "numeric_columns", "date_columns", "category_columns"]
    return manifest.select("dataset", "table", "kind", "source_column", "row_count", *[F.array_join(c, ",").alias(c) for c in lists])


_NO_LISTS = "CAST(NULL AS VARCHAR) AS numeric_columns, CAST(NULL AS VARCHAR) AS date_columns, CAST(NULL AS VARCHAR) AS category_columns"
_CATEGORY, _DATE, _CLEAN = "'id,value,source_value'", "'id,value,year,month,day'", "'customer_name,balance,segment,start_date,country'"


@register(
    "star_manifest_orders",
    f"""
    WITH tok AS (SELECT 'orders_' || substr(sha1('orders'), 1, 10) AS t)
    SELECT 'orders' AS dataset, 'bi_fact_' || t AS "table", 'Fact' AS kind, CAST(NULL AS VARCHAR) AS source_column, (SELECT count(*) FROM orders) AS row_count,
           'source_row_id,o_totalprice,o_orderpriority_id,o_orderstatus_id,o_orderdate_id' AS columns, 'o_totalprice' AS numeric_columns,
           'o_orderdate' AS date_columns, 'o_orderpriority,o_orderstatus' AS category_columns FROM tok
    UNION ALL SELECT 'orders', 'bi_dim_o_orderpriority_' || t, 'Category', 'o_orderpriority', (SELECT count(DISTINCT o_orderpriority) FROM orders), {_CATEGORY}, {_NO_LISTS} FROM tok
    UNION ALL SELECT 'orders', 'bi_dim_o_orderstatus_' || t, 'Category', 'o_orderstatus', (SELECT count(DISTINCT o_orderstatus) FROM orders), {_CATEGORY}, {_NO_LISTS} FROM tok
    UNION ALL SELECT 'orders', 'bi_dim_o_orderdate_' || t, 'Date', 'o_orderdate', (SELECT count(DISTINCT CAST(o_orderdate AS DATE)) FROM orders), {_DATE}, {_NO_LISTS} FROM tok
    """,
)
def star_manifest_orders(spark, sf):
    """M4: the manifest of a written star, counts from the files."""
    return _flat(W.write_star(_orders_star(spark, sf), shared_path(spark, "star-orders"), "orders"))


@register(
    "import_manifest_customer",
    f"""
    WITH tok AS (SELECT 'customers_' || substr(sha1('customers'), 1, 10) AS t)
    SELECT 'customers' AS dataset, 'bi_raw_' || t AS "table", 'Raw' AS kind, CAST(NULL AS VARCHAR) AS source_column, (SELECT 2 * count(*) FROM customer) AS row_count,
           'customer_name,balance,segment,start_date,empty_column,country' AS columns, {_NO_LISTS} FROM tok
    UNION ALL SELECT 'customers', 'bi_clean_' || t, 'Clean', NULL, (SELECT count(*) FROM customer), {_CLEAN}, {_NO_LISTS} FROM tok
    UNION ALL SELECT 'customers', 'bi_fact_' || t, 'Fact', NULL, (SELECT count(*) FROM customer), 'source_row_id,balance,segment_id,start_date_id', 'balance', 'start_date', 'segment' FROM tok
    UNION ALL SELECT 'customers', 'bi_dim_segment_' || t, 'Category', 'segment',
                     (SELECT count(DISTINCT c_mktsegment) FILTER (WHERE c_custkey % 10 <> 0) FROM customer), {_CATEGORY}, {_NO_LISTS} FROM tok
    UNION ALL SELECT 'customers', 'bi_dim_start_date_' || t, 'Date', 'start_date',
                     (SELECT count(DISTINCT c_custkey % 365) FILTER (WHERE c_custkey % 9 <> 0) FROM customer), {_DATE}, {_NO_LISTS} FROM tok
    """,
)
def import_manifest_customer(spark, sf):
    """Entry 1: the model manifest written by the import: raw, clean, fact and dimension tables with their counts."""
    return _flat(IF.run_import(_dirty_customers(spark, sf), "customers", ["Customer Name"]).manifest)


@register(
    "dropped_dataset_orders",
    """
    WITH tok AS (SELECT 'orders_' || substr(sha1('orders'), 1, 10) AS t),
         n AS (SELECT 'bi_fact_' || t AS "table", 'Fact' AS kind FROM tok UNION ALL SELECT 'bi_dim_o_orderpriority_' || t, 'Category' FROM tok
               UNION ALL SELECT 'bi_dim_o_orderstatus_' || t, 'Category' FROM tok UNION ALL SELECT 'bi_dim_o_orderdate_' || t, 'Date' FROM tok)
    SELECT "table", kind, true AS was_present, false AS is_present, true AS neighbour_present FROM n WHERE (SELECT count(*) FROM orders) > 0
    """,
)
def dropped_dataset_orders(spark, sf):
    """A dataset's tables are dropped by its manifest; those of a dataset with a longer name beside it stay."""
    base, star = shared_path(spark, "drop"), _orders_star(spark, sf)
    W.write_star(star, base, "orders")
    W.write_star(star, base, "orders_2")
    dropped = W.drop_dataset(spark, base, "orders")
    neighbour = W.dataset_tables(spark, base, "orders_2")
    stays = neighbour.count() > 0 and neighbour.where("not present").count() == 0
    left = [ST.table_exists(spark, f"{base}/{r['table']}") for r in dropped.collect()]
    return dropped.select("table", "kind", F.col("present").alias("was_present"), F.lit(any(left)).alias("is_present"), F.lit(stays).alias("neighbour_present"))


# ------------------------------------------------------------------ S4, S6
@register(
    "header_rows_b_customers",
    "SELECT 'Data' AS sheet, 2 AS header_row, CAST(ceil(count(*) / 500.0) AS BIGINT) AS n_files FROM customer",
)
def header_rows_b_customers(spark, sf):
    """Header detection B over workbooks of 500 customers each (title row, blank row, header)."""
    c = _t(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    cells = WBK.stored_cells(spark, WBK.write_workbooks(c, shared_path(spark, "header-xlsx"), title="Customer list", rows_per_file=500))
    best = WBK.best_sheet(cells)
    header = WBK.header_rows(cells.join(best.select("path", "sheet_no"), ["path", "sheet_no"], "left_semi"), method="B")
    return header.join(best, ["path", "sheet_no"]).groupBy("sheet", "header_row").agg(F.count(F.lit(1)).alias("n_files"))


@register(
    "guard_report_tables",
    " UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", (SELECT count(*) FROM information_schema.columns WHERE table_name = '{t}') AS n_columns, "
        f"count(*) > 1000 AS too_many_rows, (SELECT count(*) FROM information_schema.columns WHERE table_name = '{t}') < 4 AS too_few_columns, "
        f"count(*) <= 1000 AND (SELECT count(*) FROM information_schema.columns WHERE table_name = '{t}') >= 4 AS accepted FROM {t}"
        for t in ("region", "nation", "customer", "orders", "events")
    ),
)
def guard_report_tables(spark, sf):
    """Which tables an import would refuse (more than 1 000 rows, fewer than four columns)."""
    found = ST.guard_report({t: _t(spark, sf, t) for t in ("region", "nation", "customer", "orders", "events")}, 1000, 4)
    return found.withColumn("n_columns", F.col("n_columns").cast("long"))


# ------------------------------------------------------------------ U1
@register(
    "admin_summary_tables",
    """
    WITH o AS (SELECT 'orders' AS "table", CAST(o_custkey AS VARCHAR) AS owner, CAST(o_orderdate AS DATE) AS day FROM orders
               UNION ALL SELECT 'customer', c_mktsegment, NULL FROM customer
               UNION ALL SELECT 'part', NULL, NULL FROM part
               UNION ALL SELECT 'events', CAST(user_id AS VARCHAR), CAST(ts AS DATE) FROM events),
    total AS (SELECT "table", count(*) AS total FROM o GROUP BY 1),
    owners AS (SELECT "table", owner, count(*) AS n FROM o WHERE owner IS NOT NULL GROUP BY 1, 2),
    top AS (SELECT * FROM owners QUALIFY row_number() OVER (PARTITION BY "table" ORDER BY n DESC, owner) = 1),
    days AS (SELECT "table", day, count(*) AS n FROM o WHERE day IS NOT NULL GROUP BY 1, 2),
    peak AS (SELECT * FROM days QUALIFY row_number() OVER (PARTITION BY "table" ORDER BY n DESC, day) = 1),
    per AS (SELECT "table", sum(n) FILTER (WHERE day = DATE '2024-01-05') AS today, sum(n) FILTER (WHERE day >= DATE '2023-12-30') AS week,
                   sum(n) FILTER (WHERE day >= DATE '2024-01-01') AS month FROM days GROUP BY 1),
    used AS (SELECT 'customer' AS "table", count(DISTINCT o_custkey) AS used FROM orders
             UNION ALL SELECT 'orders', count(DISTINCT l_orderkey) FROM lineitem
             UNION ALL SELECT 'part', count(DISTINCT l_partkey) FROM lineitem)
    SELECT "table", total, top.owner AS top_owner, top.n AS top_owner_total,
           CASE WHEN "table" <> 'part' THEN round(coalesce(top.n, 0) * 100.0 / total, 1) END AS top_owner_percentage,
           CAST(coalesce(today, 0) AS BIGINT) AS today, CAST(coalesce(week, 0) AS BIGINT) AS this_week, CAST(coalesce(month, 0) AS BIGINT) AS this_month,
           strftime(peak.day, '%Y-%m-%d') AS peak_day, used, CASE WHEN used IS NOT NULL THEN greatest(total - used, 0) END AS unused, round(used * 100.0 / total, 1) AS usage_percentage
    FROM total LEFT JOIN top USING ("table") LEFT JOIN peak USING ("table") LEFT JOIN per USING ("table") LEFT JOIN used USING ("table")
    """,
)
def admin_summary_tables(spark, sf):
    """U1 over four catalogs in one pass: totals, top owner, periods, peak day, usage rate."""
    o, li = _t(spark, sf, "orders"), _t(spark, sf, "lineitem")
    return C.admin_summary({
        "orders": C.Catalog(o, "o_custkey", "o_orderdate", "o_orderkey", li, "l_orderkey"),
        "customer": C.Catalog(_t(spark, sf, "customer"), "c_mktsegment", None, "c_custkey", o, "o_custkey"),
        "part": C.Catalog(_t(spark, sf, "part"), None, None, "p_partkey", li, "l_partkey"),
        "events": C.Catalog(_t(spark, sf, "events"), "user_id", "ts"),
    }, "2024-01-05")


# ------------------------------------------------------------------ F17
def _french(number: str, decimals: int) -> str:
    return f"translate(format('{{:,.{decimals}f}}', round({number}, {decimals})), ',.', chr(8239) || ',')"


@register(
    "display_formats_orders",
    f"""
    SELECT o_orderkey, {_french("floor(o_totalprice)", 0)} AS number_text, {_french("o_totalprice", 2)} || chr(160) || '€' AS currency_text,
           {_french("floor(o_totalprice) / 8 * 100", 1)} || chr(160) || '%' AS percentage_text, o_orderpriority AS text_text,
           strftime(o_orderdate, '%d/%m/%Y') AS date_text,
           CASE WHEN floor(o_totalprice) < 10000 THEN {_french("floor(o_totalprice)", 0)}
                ELSE regexp_replace(CAST(CAST(floor(floor(o_totalprice) / 100 + 0.5) AS BIGINT) // 10 AS VARCHAR) || ',' || CAST(CAST(floor(floor(o_totalprice) / 100 + 0.5) AS BIGINT) % 10 AS VARCHAR), ',0$', '')
                     || chr(160) || 'k' END AS compact_text
    FROM orders
    """,
)
def display_formats_orders(spark, sf):
    """every kind of display text, numbers whole so that both engines round alike."""
    o = _t(spark, sf, "orders")
    whole = F.floor("o_totalprice")
    return o.select(
        "o_orderkey", P.format_display(whole, "number").alias("number_text"), P.format_display(F.round("o_totalprice", 2), "currency").alias("currency_text"),
        P.format_display(whole / 8, "percentage").alias("percentage_text"), P.format_display("o_orderpriority", "text").alias("text_text"),
        P.format_display("o_orderdate", "date").alias("date_text"), P.format_display(whole, "number", compact=True).alias("compact_text"),
    )


# ------------------------------------------------------------------ W1, W7
@register(
    "dashboard_text_dates",
    """
    WITH o AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderpriority AS prio, o_totalprice AS v FROM orders),
    r AS (SELECT 'by_day' AS widget_id, 'line_chart' AS widget_type, month AS label, sum(v) AS value FROM o GROUP BY month
          UNION ALL SELECT 'by_iso', 'line_chart', month, avg(v) FROM o GROUP BY month
          UNION ALL SELECT 'by_priority', 'line_chart', prio, CAST(count(*) AS DOUBLE) FROM o GROUP BY prio)
    SELECT widget_id, widget_type, label, round(value, 2) AS value, CAST(row_number() OVER (PARTITION BY widget_id ORDER BY label) AS INTEGER) AS rank, CAST(NULL AS VARCHAR) AS error FROM r
    UNION ALL SELECT 'total', 'kpi_card', 'value', round(sum(v), 2), 1, NULL FROM o
    """,
)
def dashboard_text_dates(spark, sf):
    """Two lines over text dates in different orders and one over plain text, one scan of the table."""
    o = _t(spark, sf, "orders").select(
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("day"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("iso"), "o_orderpriority", "o_totalprice")
    line = lambda name, x, agg: {"id": name, "type": "line_chart", "data": {"x": x, "y": "o_totalprice", "aggregation": agg}}
    spec = {"widgets": [line("by_day", "day", "sum"), line("by_iso", "iso", "avg"), line("by_priority", "o_orderpriority", "count"),
                        {"id": "total", "type": "kpi_card", "data": {"metric": "o_totalprice", "aggregation": "sum"}}]}
    return D.run_dashboard(o, spec, digits=2)[0]


@register(
    "auto_charts_orders",
    f"""
    WITH p AS ({_ORDERS_PROFILE_SQL}),
    m AS (SELECT name, row_number() OVER (ORDER BY position) AS k FROM p WHERE semantic_role = 'Measure'),
    d AS (SELECT name, row_number() OVER (ORDER BY position) AS k FROM p WHERE semantic_role IN ('Dimension', 'Date Dimension')),
    c AS (SELECT m.name AS measure, d.name AS dim FROM m JOIN d USING (k) WHERE k <= 2),
    v AS (SELECT * FROM (SELECT 'o_orderkey' AS measure, o_orderkey::DOUBLE AS x, o_orderkey AS id FROM orders UNION ALL SELECT 'o_custkey', o_custkey, o_orderkey FROM orders
                         UNION ALL SELECT 'o_totalprice', o_totalprice, o_orderkey FROM orders)),
    k AS (SELECT * FROM (SELECT 'o_orderstatus' AS dim, o_orderstatus AS label, o_orderkey AS id FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority, o_orderkey FROM orders
                         UNION ALL SELECT 'o_orderdate', strftime(o_orderdate, '%Y-%m-%d'), o_orderkey FROM orders)),
    r AS (SELECT 'auto_' || measure || '_' || dim AS chart, dim, label, coalesce(sum(x), 0) AS value FROM c JOIN v USING (measure) JOIN k USING (dim, id) WHERE label IS NOT NULL GROUP BY ALL)
    SELECT chart, label, round(value, 4) AS value FROM r
    QUALIFY CASE WHEN dim = 'o_orderdate' THEN row_number() OVER (PARTITION BY chart ORDER BY label) ELSE row_number() OVER (PARTITION BY chart ORDER BY value DESC, label) END <= 10
    """,
)
def auto_charts_orders(spark, sf):
    """All automatic charts of a table."""
    o = _t(spark, sf, "orders").withColumn("o_orderdate", F.to_date("o_orderdate"))
    return D.auto_chart_rows(o, PR.profile(o, order_by=["o_orderkey"], most_frequent=False))
