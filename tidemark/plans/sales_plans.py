"""Registered sales queries with their check SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.text import letter_prefix
from tidemark.operators import cleaning, forecast, quality, sales
from tidemark.plans.common import SALES, money, quoted, r, rounded, with_ctes
from tidemark.constants import STATE_CODES
from tidemark.plans.holt_sql import holt_ahead, holt_ctes
from tidemark.sources import files
from tidemark.sources.tables import sales_lines
from tidemark.staging import new_path

REGIONS = ["AMERICA", "ASIA", "EUROPE"]
CATEGORIES = ["ECONOMY", "LARGE", "PROMO"]
START, END = "1996-01-01", "1999-12-31"
FOCUS = f"""order_date >= TIMESTAMP '{START}' AND order_date <= TIMESTAMP '{END}'
  AND region IN ({quoted(REGIONS)}) AND category IN ({quoted(CATEGORIES)})"""


def _sql(body: str) -> str:
    return with_ctes(body, sales=SALES)


def _total_query(key: str, descending: bool = False):
    def run(spark, d):
        return rounded(sales.total_by(sales_lines(spark, d, key, "sales", total=("sales",)), key, descending=descending))

    return run, _sql(f"SELECT {key}, {r(money('sales'))} AS total FROM sales WHERE {key} IS NOT NULL GROUP BY {key}")


def _top_query(key: str, n: int = 10):
    def run(spark, d):
        return rounded(sales.top_by(sales_lines(spark, d, key, "sales", total=("sales",)), key, n=n))

    return run, _sql(
        f"""SELECT {key}, {r('t')} AS total FROM (SELECT {key}, {money('sales')} AS t FROM sales
        WHERE {key} IS NOT NULL GROUP BY {key}) ORDER BY t DESC, {key} LIMIT {n}"""
    )


def _count_query(key: str):
    def run(spark, d):
        return rounded(sales.value_counts(sales_lines(spark, d, key), key))

    return run, _sql(
        f"""SELECT {key}, COUNT(*) AS cnt, {r('COUNT(*) * 100.0::DOUBLE / SUM(COUNT(*)) OVER ()')} AS share_pct
        FROM sales WHERE {key} IS NOT NULL GROUP BY {key}"""
    )


def _filtered(spark, d, *columns):
    """The filter on three regions, three categories and four years."""
    lines = sales_lines(spark, d, *{*columns, "order_date", "region", "category"})
    return sales.filter_sales(lines, START, END, REGIONS, CATEGORIES)


def exec_kpis(spark, d):
    return rounded(sales.executive_kpis(sales_lines(spark, d, "order_id", "sales", "profit")))


def exec_kpis_by_region(spark, d):
    return rounded(sales.executive_kpis(sales_lines(spark, d, "region", "order_id", "sales", "profit"), by="region"))


_KPIS = f"""SELECT {{key}}{money('sales')} AS revenue, COUNT(DISTINCT order_id) AS orders, {money('profit')} AS profit
  FROM sales {{group}}"""
_KPI_OUT = f"""SELECT {{key}}{r('revenue')} AS revenue, orders, {r('COALESCE(revenue / NULLIF(orders, 0), 0)')} AS avg_order_value,
  {r('profit')} AS profit, {r('COALESCE(profit / NULLIF(revenue, 0) * 100, 0)')} AS margin_pct FROM k"""


def kpi_labels(spark, d):
    return sales.kpi_labels(sales.executive_kpis(sales_lines(spark, d, "order_id", "sales", "profit")))


def filter_date_region_category(spark, d):
    chosen = _filtered(spark, d, "order_id", "sales", "quantity")
    return rounded(chosen.select("order_id", "order_date", "region", "category", "quantity", "sales"))


def filtered_kpis(spark, d):
    return rounded(sales.executive_kpis(_filtered(spark, d, "order_id", "sales", "profit").drop("order_date")))


def distinct_values(spark, d):
    region = sales.distinct_values(sales_lines(spark, d, "region"), "region").select(F.lit("region").alias("field"), "value")
    category = sales.distinct_values(sales_lines(spark, d, "category"), "category").select(F.lit("category").alias("field"), "value")
    return region.unionByName(category)


def range_and_counts(spark, d):
    kept = F.col("region").isin(REGIONS) & (F.col("order_date") >= F.lit("1996-06-01").cast("timestamp_ntz"))
    return sales.range_and_counts(sales_lines(spark, d, "order_date", "region"), kept)


def processing_days(spark, d):
    return sales.processing_days(sales_lines(spark, d, "order_id", "order_date", "ship_date"))


def processing_hist(spark, d):
    return rounded(sales.processing_histogram(sales_lines(spark, d, "order_date", "ship_date")))


def revenue_yoy(spark, d):
    return rounded(sales.revenue_growth(sales_lines(spark, d, "order_date", "sales")))


def monthly_trend(spark, d):
    return rounded(sales.monthly_total(sales_lines(spark, d, "order_date", "sales", total=("sales",))))


def monthly_profit(spark, d):
    return rounded(sales.monthly_total(sales_lines(spark, d, "order_date", "profit"), "profit"))


def yearly_sales(spark, d):
    return rounded(sales.yearly_sales(sales_lines(spark, d, "order_date", "sales")))


def quarterly_sales(spark, d):
    return rounded(sales.quarterly_sales(sales_lines(spark, d, "order_date", "sales"), 1998))


def sales_by_state_code(spark, d):
    return rounded(sales.sales_by_state_code(sales_lines(spark, d, "state", "sales", total=("sales",))))


def sales_grouping_sets(spark, d):
    dims = ["region", "category", "segment", "state", "ship_mode"]
    return rounded(sales.grouping_sets_totals(sales_lines(spark, d, *dims, "sales"), dims))


def customer_rollup(spark, d):
    return rounded(sales.customer_rollup(sales_lines(spark, d, "customer_id", "order_id", "sales")))


def customer_kpis(spark, d):
    return rounded(sales.customer_kpis(sales_lines(spark, d, "customer_id", "order_id", "sales")))


def top_customers(spark, d):
    return rounded(sales.top_customers(sales_lines(spark, d, "customer_id", "order_id", "sales")))


def customer_order_freq(spark, d):
    return sales.customer_order_frequency(sales_lines(spark, d, "customer_id", "customer_name", "segment", "order_id"))


def customer_sales(spark, d):
    return rounded(sales.customer_sales(sales_lines(spark, d, "customer_id", "customer_name", "segment", "sales")))


def subcats_per_category(spark, d):
    return sales.distinct_per_group(sales_lines(spark, d, "category", "sub_category"), "category", "sub_category")


def distinct_customers(spark, d):
    return sales.distinct_count(sales_lines(spark, d, "customer_name"), "customer_name")


def segment_nonnull_counts(spark, d):
    columns = ["segment", "order_id", "order_date", "ship_date", "ship_mode", "customer_id", "region", "category", "sales"]
    return sales.nonnull_counts(sales_lines(spark, d, *columns), "segment")


def id_prefixes(spark, d):
    lines = sales_lines(spark, d, "order_code", "customer_name")
    both = lines.select(
        F.explode(
            F.array(
                F.struct(F.lit("order").alias("field"), letter_prefix("order_code").alias("prefix")),
                F.struct(F.lit("customer").alias("field"), letter_prefix("customer_name").alias("prefix")),
            )
        ).alias("x")
    )
    return both.select("x.field", "x.prefix").distinct()


def _text_sales(spark, d):
    """Sales lines as a careless text export: padded headers, two date styles, junk in some cells."""
    lines = sales_lines(spark, d, "order_id", "order_date", "ship_date", "sales", "profit")
    key = F.col("order_id")
    date = (
        F.when(F.pmod(key, F.lit(29)) == 0, F.lit("unknown"))
        .when(F.pmod(key, F.lit(2)) == 0, F.date_format("order_date", "MM/dd/yyyy"))
        .otherwise(F.date_format("order_date", "yyyy-MM-dd"))
    )
    amount = (
        F.when(F.pmod(key, F.lit(37)) == 0, F.lit("n/a"))
        .when(F.pmod(key, F.lit(41)) == 0, F.lit(" "))
        .otherwise(F.concat(F.lit(" "), F.col("sales").cast("string")))
    )
    return lines.select(
        key.alias(" Order ID"),
        date.alias("Order Date "),
        F.date_format("ship_date", "yyyy-MM-dd").alias("Ship Date"),
        amount.alias(" Sales "),
        F.col("profit").cast("string").alias("Profit"),
    )


def sales_clean(spark, d):
    clean = cleaning.clean_sales(cleaning.trim_headers(_text_sales(spark, d)))
    names = ["order_id", "order_date", "ship_date", "order_year", "order_month", "sales", "profit", "quantity"]
    return rounded(clean.toDF(*names))


_DATE = "CASE WHEN order_id % 29 = 0 THEN NULL ELSE order_date END"


def preview_head(spark, d):
    columns = ["order_id", "ship_date", "product_name", "quantity", "sales"]
    return rounded(sales_lines(spark, d, *columns).orderBy(*columns).limit(250))


def preview_sample(spark, d):
    lines = sales_lines(spark, d, "order_id", "product_name", "order_date", "region", "category", "sales")
    return rounded(quality.random_rows(lines, 500, key=["order_id", "product_name"]))


def _monthly(spark, d, key="region"):
    total = () if key == "sub_category" else ("sales",)  # a part and an order have one line in common
    lines = sales_lines(spark, d, "order_date", key, "sales", total=total)
    monthly = sales.monthly_total(lines, "sales", [key]).withColumnRenamed("sales", "y")
    return forecast.dense_months(monthly, [key])


def monthly_dense(spark, d):
    """Monthly totals per product, with the months a product was not sold filled in."""
    return rounded(_monthly(spark, d, "sub_category"))


def ma_forecast(spark, d):
    return rounded(forecast.moving_average_forecast(_monthly(spark, d), ["region"], 30))


def forecast_summary(spark, d):
    dense = _monthly(spark, d)
    return rounded(forecast.forecast_summary(forecast.moving_average_forecast(dense, ["region"], 30), dense, ["region"]))


def history_plus_forecast(spark, d):
    dense = _monthly(spark, d)
    return rounded(forecast.history_plus_forecast(dense, forecast.moving_average_forecast(dense, ["region"], 30), ["region"]))


def stored_sales_kpis(spark, d):
    """The filter and figures on the stored sales table, which needs no join."""
    path = new_path(spark, "sales-table")
    columns = ["order_id", "order_date", "region", "category", "sales", "profit"]
    files.write_sales_table(sales_lines(spark, d, *columns), path)
    chosen = sales.filter_sales(files.read_sales_table(spark, path, (1996, 1999)), START, END, REGIONS, CATEGORIES)
    return rounded(sales.executive_kpis(chosen))


def sales_forecast(spark, d):
    """Total monthly sales and their forecast for 120 months as one table."""
    dense, ahead = forecast.sales_forecast(sales_lines(spark, d, "order_date", "sales"), 120)
    return rounded(forecast.history_plus_forecast(dense, ahead, ["series"]))


def sales_forecast_summary(spark, d):
    dense, ahead = forecast.sales_forecast(sales_lines(spark, d, "order_date", "region", "sales", total=("sales",)), 30, keys=["region"])
    return rounded(forecast.forecast_summary(ahead, dense, ["region"]))


def holt_forecast(spark, d):
    """Holt forecasts of every region and category for 30 months."""
    lines = sales_lines(spark, d, "order_date", "region", "category", "sales")
    keys = ["region", "category"]
    monthly = sales.monthly_total(lines, "sales", keys).withColumnRenamed("sales", "y")
    return rounded(forecast.holt_forecast(forecast.dense_months(monthly, keys), keys, 30))


def holt_fits(spark, d):
    """The Holt fit of every state: weights, last level and slope, errors."""
    fits = forecast.holt_levels(_monthly(spark, d, "state"), ["state"])
    return rounded(fits.withColumn("rmse", F.sqrt(F.col("sse") / F.col("months"))).drop("sse"))


def _dense_sql(key: str = "region") -> dict[str, str]:
    return {
        "sales": SALES,
        "m": f"SELECT {key}, date_trunc('month', order_date) AS month, {money('sales')} AS y FROM sales GROUP BY ALL",
        "dense": f"""SELECT g.{key}, CAST(g.month AS TIMESTAMP) AS month, COALESCE(m.y, 0) AS y FROM (SELECT {key},
          unnest(generate_series(MIN(month), MAX(month), INTERVAL 1 MONTH)) AS month FROM m GROUP BY {key}) g
          LEFT JOIN m ON m.{key} = g.{key} AND m.month = g.month""",
        "rolled": f"""SELECT *, CASE WHEN COUNT(y) OVER w = 3 THEN AVG(y) OVER w END AS roll FROM dense
          WINDOW w AS (PARTITION BY {key} ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
        "lv": f"""SELECT {key}, COALESCE(arg_max(roll, month) FILTER (roll IS NOT NULL), AVG(y)) AS level,
          COALESCE(stddev_pop(y - roll), 0) AS sigma, MAX(month) AS last_month FROM rolled GROUP BY {key}""",
        "fc": f"""SELECT {key}, CAST(step AS INTEGER) AS step, CAST(last_month + to_months(CAST(step AS INTEGER)) AS TIMESTAMP) AS ds,
          level AS yhat, level - 1.96 * sigma AS yhat_lower, level + 1.96 * sigma AS yhat_upper
          FROM lv, generate_series(1, 30) t(step)""",
    }


def _holt_sql(key: str, periods: int) -> dict[str, str]:
    """From the sales to ``dense``, ``fits`` and ``fc``; all series are long enough for a fit."""
    keys = key.split(", ")
    same = " AND ".join(f"m.{k} = g.{k}" for k in keys)
    return {
        "sales": f"SELECT *, 'all' AS series FROM ({SALES})",
        "m": f"SELECT {key}, date_trunc('month', order_date) AS month, {money('sales')} AS y FROM sales GROUP BY ALL",
        "dense": f"""SELECT {", ".join(f"g.{k}" for k in keys)}, CAST(g.month AS TIMESTAMP) AS month, COALESCE(m.y, 0) AS y FROM (SELECT {key},
          unnest(generate_series(MIN(month), MAX(month), INTERVAL 1 MONTH)) AS month FROM m GROUP BY {key}) g
          LEFT JOIN m ON {same} AND m.month = g.month""",
        **holt_ctes(keys),
        "fc": holt_ahead(keys, periods),
    }


_CUST = f"""SELECT customer_id, COUNT(DISTINCT order_id) AS orders, {money('sales')} AS revenue FROM sales
  WHERE customer_id IS NOT NULL GROUP BY customer_id"""
_STATE_ROWS = ", ".join(f"('{name}', '{code}')" for name, code in STATE_CODES.items())

QUERIES = {
    "exec_kpis": (exec_kpis, with_ctes(_KPI_OUT.format(key=""), sales=SALES, k=_KPIS.format(key="", group=""))),
    "exec_kpis_by_region": (
        exec_kpis_by_region,
        with_ctes(_KPI_OUT.format(key="region, "), sales=SALES, k=_KPIS.format(key="region, ", group="GROUP BY region")),
    ),
    "filtered_kpis": (
        filtered_kpis,
        with_ctes(_KPI_OUT.format(key=""), sales=SALES, k=_KPIS.format(key="", group=f"WHERE {FOCUS}")),
    ),
    "kpi_labels": (
        kpi_labels,
        with_ctes(
            """SELECT '$' || format('{:,.0f}', revenue) AS total_revenue, format('{:,}', orders) AS total_orders,
            '$' || format('{:,.2f}', COALESCE(revenue / NULLIF(orders, 0), 0)) AS avg_order_value,
            printf('%.1f', COALESCE(profit / NULLIF(revenue, 0) * 100, 0)) || '%' AS profit_margin FROM k""",
            sales=SALES,
            k=_KPIS.format(key="", group=""),
        ),
    ),
    "filter_date_region_category": (
        filter_date_region_category,
        _sql(f"SELECT order_id, order_date, region, category, quantity, {r('sales')} AS sales FROM sales WHERE {FOCUS}"),
    ),
    "distinct_values": (
        distinct_values,
        _sql("SELECT DISTINCT 'region' AS field, region AS value FROM sales UNION ALL SELECT DISTINCT 'category', category FROM sales"),
    ),
    "range_and_counts": (
        range_and_counts,
        _sql(
            f"""SELECT MIN(order_date) AS min_date, MAX(order_date) AS max_date, COUNT(*) AS total_rows,
            COUNT(*) FILTER (k) AS filtered_rows, strftime(MIN(order_date) FILTER (k), '%b %Y') AS filtered_from
            FROM (SELECT order_date, region IN ({quoted(REGIONS)}) AND order_date >= TIMESTAMP '1996-06-01' AS k FROM sales)"""
        ),
    ),
    "processing_days": (
        processing_days,
        _sql("SELECT order_id, order_date, ship_date, CAST(floor(epoch(ship_date - order_date) / 86400) AS INTEGER) AS processing_days FROM sales"),
    ),
    "processing_hist": (
        processing_hist,
        _sql(
            f"""SELECT bin, {r('MAX(lo) + (MAX(hi) - MAX(lo)) / 30.0::DOUBLE * (bin - 1)')} AS bin_from,
            {r('MAX(lo) + (MAX(hi) - MAX(lo)) / 30.0::DOUBLE * bin')} AS bin_to, COUNT(*) AS cnt
            FROM (SELECT CAST(LEAST(floor((x - lo) * 1.0::DOUBLE / (hi - lo) * 30) + 1, 30) AS INTEGER) AS bin, lo, hi FROM
              (SELECT x, MIN(x) OVER () AS lo, MAX(x) OVER () AS hi FROM
                (SELECT datediff('day', order_date, ship_date) AS x FROM sales))) GROUP BY bin"""
        ),
    ),
    "revenue_yoy": (
        revenue_yoy,
        _sql(
            f"""SELECT year, previous_year, {r('rev')} AS revenue, {r('prev')} AS previous_revenue, {r('g')} AS revenue_yoy,
            CASE WHEN g >= 0 THEN '+' ELSE '' END || printf('%.1f', g * 100) || '%' AS revenue_yoy_label
            FROM (SELECT *, (rev - prev) / NULLIF(prev, 0) AS g FROM (SELECT year, rev, LAG(year) OVER (ORDER BY year) AS previous_year,
              LAG(rev) OVER (ORDER BY year) AS prev FROM (SELECT CAST(year(order_date) AS INTEGER) AS year, {money('sales')} AS rev
              FROM sales GROUP BY 1))) ORDER BY year DESC LIMIT 1"""
        ),
    ),
    "monthly_trend": (
        monthly_trend,
        _sql(f"SELECT CAST(date_trunc('month', order_date) AS TIMESTAMP) AS month, {r(money('sales'))} AS sales FROM sales GROUP BY 1"),
    ),
    "monthly_profit": (
        monthly_profit,
        _sql(f"SELECT CAST(date_trunc('month', order_date) AS TIMESTAMP) AS month, {r(money('profit'))} AS profit FROM sales GROUP BY 1"),
    ),
    "yearly_sales": (
        yearly_sales,
        _sql(f"SELECT CAST(year(order_date) AS INTEGER) AS year, {r(money('sales'))} AS total_sales FROM sales GROUP BY 1"),
    ),
    "quarterly_sales": (
        quarterly_sales,
        with_ctes(
            f"""SELECT CAST(last_day(CAST(g.q AS DATE) + INTERVAL 2 MONTH) AS TIMESTAMP) AS quarter_end, {r('COALESCE(t, 0)')} AS total_sales
            FROM (SELECT unnest(generate_series(MIN(q), MAX(q), INTERVAL 3 MONTH)) AS q FROM s) g LEFT JOIN s ON s.q = g.q""",
            sales=SALES,
            s=f"SELECT date_trunc('quarter', order_date) AS q, {money('sales')} AS t FROM sales WHERE year(order_date) = 1998 GROUP BY 1",
        ),
    ),
    "sales_by_region": _total_query("region"),
    "sales_by_category": _total_query("category"),
    "sales_by_segment": _total_query("segment"),
    "sales_by_subcategory": _total_query("sub_category"),
    "top_products": _top_query("product_name"),
    "top_states": _top_query("state"),
    "ship_mode_share": _count_query("ship_mode"),
    "value_counts_ship_mode": _count_query("ship_mode"),
    "value_counts_segment": _count_query("segment"),
    "value_counts_state": _count_query("state"),
    "value_counts_category": _count_query("category"),
    "sales_by_state_code": (
        sales_by_state_code,
        _sql(
            f"""SELECT s.state, v.state_code, {r('t')} AS total FROM (SELECT state, {money('sales')} AS t FROM sales GROUP BY state) s
            JOIN (VALUES {_STATE_ROWS}) v(state, state_code) ON v.state = s.state"""
        ),
    ),
    "sales_grouping_sets": (
        sales_grouping_sets,
        _sql(
            " UNION ALL ".join(
                f"SELECT '{k}' AS dimension, {k} AS label, {r(money('sales'))} AS total FROM sales GROUP BY {k}"
                for k in ["region", "category", "segment", "state", "ship_mode"]
            )
        ),
    ),
    "customer_rollup": (
        customer_rollup,
        with_ctes(f"SELECT customer_id, orders, {r('revenue')} AS revenue FROM c", sales=SALES, c=_CUST),
    ),
    "customer_kpis": (
        customer_kpis,
        with_ctes(
            f"""SELECT {r('AVG(CAST(orders > 1 AS INTEGER))')} AS repeat_rate,
            {r('CAST(SUM(CAST(revenue AS DECIMAL(28,8))) AS DOUBLE) / COUNT(*)')} AS avg_customer_value, COUNT(*) AS customers FROM c""",
            sales=SALES,
            c=_CUST,
        ),
    ),
    "top_customers": (
        top_customers,
        with_ctes(
            f"SELECT customer_id, orders, {r('revenue')} AS revenue FROM c ORDER BY c.revenue DESC, customer_id LIMIT 10",
            sales=SALES,
            c=_CUST,
        ),
    ),
    "customer_order_freq": (
        customer_order_freq,
        _sql(
            """SELECT customer_id, customer_name, segment, COUNT(order_id) AS total_orders FROM sales GROUP BY ALL
            HAVING COUNT(order_id) >= 1 ORDER BY total_orders DESC, customer_id LIMIT 5"""
        ),
    ),
    "customer_sales": (
        customer_sales,
        _sql(
            f"""SELECT customer_id, customer_name, segment, {r('t')} AS total_sales FROM (SELECT customer_id, customer_name, segment,
            {money('sales')} AS t FROM sales GROUP BY ALL) ORDER BY t DESC, customer_id LIMIT 5"""
        ),
    ),
    "subcats_per_category": (
        subcats_per_category,
        _sql("SELECT category, COUNT(DISTINCT sub_category) AS total_count FROM sales GROUP BY category"),
    ),
    "distinct_customers": (distinct_customers, _sql("SELECT COUNT(DISTINCT customer_name) AS distinct_values FROM sales")),
    "segment_nonnull_counts": (
        segment_nonnull_counts,
        _sql(
            "SELECT segment, "
            + ", ".join(
                f"COUNT({c}) AS {c}"
                for c in ["order_id", "order_date", "ship_date", "ship_mode", "customer_id", "region", "category", "sales"]
            )
            + " FROM sales GROUP BY segment"
        ),
    ),
    "id_prefixes": (
        id_prefixes,
        _sql(
            """SELECT DISTINCT 'order' AS field, NULLIF(regexp_extract(order_code, '([A-Za-z]+)', 1), '') AS prefix FROM sales
            UNION ALL SELECT DISTINCT 'customer', NULLIF(regexp_extract(customer_name, '([A-Za-z]+)', 1), '') FROM sales"""
        ),
    ),
    "sales_clean": (
        sales_clean,
        _sql(
            f"""SELECT order_id, {_DATE} AS order_date, ship_date, CAST(year({_DATE}) AS INTEGER) AS order_year,
            CAST(date_trunc('month', {_DATE}) AS TIMESTAMP) AS order_month,
            CASE WHEN order_id % 37 = 0 OR order_id % 41 = 0 THEN 0 ELSE {r('sales')} END AS sales, {r('profit')} AS profit,
            CAST(0 AS DOUBLE) AS quantity FROM sales"""
        ),
    ),
    "preview_head": (
        preview_head,
        _sql(
            f"""SELECT order_id, ship_date, product_name, quantity, {r('sales')} AS sales FROM sales
            ORDER BY order_id, ship_date, product_name, quantity, sales.sales LIMIT 250"""
        ),
    ),
    "preview_sample": (
        preview_sample,
        with_ctes(
            f"""SELECT order_id, product_name, order_date, region, category, {r('sales')} AS sales FROM s
            ORDER BY substr(md5('42|' || order_id || '|' || product_name), 1, 13), order_id, product_name, sales LIMIT 500""",
            s=SALES,
        ),
    ),
    "monthly_dense": (
        monthly_dense,
        with_ctes(f"SELECT sub_category, month, {r('y')} AS y FROM dense", **_dense_sql("sub_category")),
    ),
    "ma_forecast": (
        ma_forecast,
        with_ctes(
            f"SELECT region, step, ds, {r('yhat')} AS yhat, {r('yhat_lower')} AS yhat_lower, {r('yhat_upper')} AS yhat_upper FROM fc",
            **_dense_sql(),
        ),
    ),
    "forecast_summary": (
        forecast_summary,
        with_ctes(
            f"""SELECT f.region, {r('AVG(f.yhat)')} AS avg_forecast, {r('MAX(f.yhat)')} AS max_forecast, {r('MIN(f.yhat)')} AS min_forecast,
            {r('(arg_max(f.yhat, f.ds) - MAX(h.last)) / NULLIF(MAX(h.last), 0) * 100')} AS growth_pct
            FROM fc f JOIN (SELECT region, arg_max(y, month) AS last FROM dense GROUP BY region) h ON h.region = f.region GROUP BY f.region""",
            **_dense_sql(),
        ),
    ),
    "history_plus_forecast": (
        history_plus_forecast,
        with_ctes(
            f"""SELECT region, 'history' AS part, month AS ds, {r('y')} AS yhat, CAST(NULL AS DOUBLE) AS yhat_lower,
            CAST(NULL AS DOUBLE) AS yhat_upper FROM dense UNION ALL
            SELECT region, 'forecast', ds, {r('yhat')}, {r('yhat_lower')}, {r('yhat_upper')} FROM fc""",
            **_dense_sql(),
        ),
    ),
    "stored_sales_kpis": (
        stored_sales_kpis,
        with_ctes(_KPI_OUT.format(key=""), sales=SALES, k=_KPIS.format(key="", group=f"WHERE {FOCUS}")),
    ),
    "sales_forecast": (
        sales_forecast,
        with_ctes(
            f"""SELECT series, 'history' AS part, month AS ds, {r('y')} AS yhat, CAST(NULL AS DOUBLE) AS yhat_lower, CAST(NULL AS DOUBLE) AS yhat_upper FROM dense
            UNION ALL SELECT series, 'forecast', ds, {r('yhat')}, {r('yhat_lower')}, {r('yhat_upper')} FROM fc""",
            **_holt_sql("series", 120),
        ),
    ),
    "sales_forecast_summary": (
        sales_forecast_summary,
        with_ctes(
            f"""SELECT region, {r('AVG(yhat)')} AS avg_forecast, {r('MAX(yhat)')} AS max_forecast, {r('MIN(yhat)')} AS min_forecast,
              {r('(arg_max(yhat, ds) - any_value(last_value)) / NULLIF(any_value(last_value), 0) * 100')} AS growth_pct
            FROM fc JOIN (SELECT region, last_value FROM fits) USING (region) GROUP BY region""",
            **_holt_sql("region", 30),
        ),
    ),
    "holt_forecast": (
        holt_forecast,
        with_ctes(
            f"SELECT region, category, step, ds, {r('yhat')} AS yhat, {r('yhat_lower')} AS yhat_lower, {r('yhat_upper')} AS yhat_upper FROM fc",
            **_holt_sql("region, category", 30),
        ),
    ),
    "holt_fits": (
        holt_fits,
        with_ctes(
            f"""SELECT state, last_month, {r('last_value')} AS last_value, CAST(months AS INTEGER) AS months, {r('alpha')} AS alpha, {r('beta')} AS beta,
              {r('level')} AS level, {r('trend')} AS trend, {r('sqrt(sse / months)')} AS rmse, {r('sigma')} AS sigma, 'holt' AS method FROM fits""",
            **_holt_sql("state", 30),
        ),
    ),
}
