"""The catalog's queries as plain SQL over the same tables, for a second engine."""

from __future__ import annotations

from clickfold.plans.catalog import CUTOFF, DAY, EMPTY_DAY, REPLACE_FROM, SEEN_BEFORE
from clickfold.schemas import CLICK_TOPIC, MAIN_TOPIC, PURCHASE_TOPIC

ISO = "'%Y-%m-%dT%H:%M:%S.%fZ'"

RAW = """
ids AS (
  SELECT event_id, upper(event_type) AS event_type,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS product_id,
         CAST(value AS DECIMAL(10,2)) AS product_price, user_id, ts AS created_at
  FROM events
),
raw AS (
  SELECT i.*, p.p_name AS product_name, p.p_type AS product_category,
         concat_ws(', ', n.n_name, r.r_name) AS location,
         CAST(i.created_at AS DATE) AS day
  FROM ids i
  LEFT JOIN part p ON p.p_partkey = i.product_id
  LEFT JOIN customer c ON c.c_custkey = i.user_id
  LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
  LEFT JOIN region r ON r.r_regionkey = n.n_regionkey
)
"""

LOG = f"""
log AS (
  SELECT *, '{MAIN_TOPIC}' AS topic, product_id % 3 AS part_no FROM raw
  UNION ALL
  SELECT *, '{CLICK_TOPIC}', product_id % 3 FROM raw WHERE event_type = 'CLICK'
  UNION ALL
  SELECT *, '{PURCHASE_TOPIC}', 0 FROM raw WHERE event_type = 'PURCHASE'
)
"""

V = "count(*) FILTER (event_type = 'VIEW')"
C = "count(*) FILTER (event_type = 'CLICK')"
P = "count(*) FILTER (event_type = 'PURCHASE')"
REVENUE = "CAST(sum(CASE WHEN event_type = 'PURCHASE' THEN product_price ELSE 0 END) AS DOUBLE)"
REVENUE_OR_0 = f"coalesce({REVENUE}, 0)"


def _ratio(num: str, den: str, steps: int, scale: int) -> str:
    """Half-up quotient in integer arithmetic."""
    return (
        f"CASE WHEN {den} > 0 THEN CAST(({2 * steps} * {num} + {den}) // (2 * {den}) AS DOUBLE)"
        f" / {10**scale} ELSE 0.0 END"
    )


def _fraction(num: str, den: str) -> str:
    return _ratio(num, den, 10_000, 4)


def _percent(num: str, den: str) -> str:
    return _ratio(num, den, 10_000, 2)


def _raw(select: str) -> str:
    return f"WITH {RAW} {select}"


def _log(select: str) -> str:
    return f"WITH {RAW}, {LOG} {select}"


def _product_metrics(where: str = "TRUE") -> str:
    return _raw(
        f"""
        SELECT CAST(day AS VARCHAR) AS metric_date, product_id, product_name,
               product_category AS category, count(*) AS total_events, {V} AS total_views,
               {C} AS total_clicks, {P} AS total_purchases, {REVENUE} AS total_revenue,
               {_fraction(C, V)} AS click_through_rate, {_fraction(P, V)} AS conversion_rate,
               strftime(max(created_at), {ISO}) AS updated_at
        FROM raw WHERE {where} GROUP BY day, product_id, product_name, product_category
        """
    )


PRODUCT_METRICS_DAILY = _raw(
    f"""
    SELECT CAST(day AS VARCHAR) AS event_date, product_id, product_name,
           product_category AS category, {V} AS total_views, {C} AS total_clicks,
           {P} AS total_purchases, {REVENUE} AS total_revenue,
           {_fraction(C, V)} AS click_through_rate, {_fraction(P, V)} AS conversion_rate
    FROM raw GROUP BY day, product_id, product_name, product_category
    """
)

FUNNEL_ANALYSIS = _raw(
    f"""
    SELECT CAST(day AS VARCHAR) AS event_date, count(event_id) AS total_events,
           {V} AS total_views, {C} AS total_clicks, {P} AS total_purchases,
           {REVENUE} AS total_revenue, {_percent(C, V)} AS view_to_click_rate,
           {_percent(P, C)} AS click_to_purchase_rate, {_percent(P, V)} AS overall_conversion_rate
    FROM raw GROUP BY day
    """
)


def _funnel_columns(day: str) -> str:
    return f"""
        {day} AS metric_date, {V} AS total_views, {C} AS total_clicks, {P} AS total_purchases,
        {_percent(C, V)} AS view_to_click_pct, {_percent(P, C)} AS click_to_purchase_pct,
        {_percent(P, V)} AS overall_conversion_pct
    """


def _funnel_on(day) -> str:
    return _raw(f"SELECT {_funnel_columns(f"'{day}'")} FROM raw WHERE day = DATE '{day}'")


def _events_per_sec(seconds: int) -> str:
    return f"""
        SELECT {seconds} AS seconds, count(*) // {seconds} AS events_per_sec FROM events
        WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL {seconds} SECONDS
    """


def _latest(where: str) -> str:
    return _raw(
        f"""
        SELECT event_id, event_type, product_id, product_name, product_category,
               CAST(coalesce(product_price, 0) AS DOUBLE) AS product_price, user_id, location,
               strftime(created_at, {ISO}) AS "timestamp"
        FROM raw WHERE {where} ORDER BY created_at DESC, event_id DESC LIMIT 50
        """
    )


TOP_PRODUCTS = f"""
    SELECT product_name AS name, product_category AS category, count(*) AS events,
           {REVENUE_OR_0} AS revenue, {C} AS clicks, {P} AS purchases,
           {_percent(C, f'greatest({V}, 1)')} AS ctr
    FROM raw GROUP BY product_name, product_category
    ORDER BY {REVENUE} DESC NULLS FIRST, product_name, product_category LIMIT 8
"""

ORACLES: dict[str, str] = {
    "stg_events": _raw(
        f"""
        SELECT event_id, event_type, product_id, product_name, product_category,
               CAST(product_price AS DOUBLE) AS product_price, user_id, location,
               strftime(created_at, {ISO}) AS event_timestamp, CAST(day AS VARCHAR) AS event_date,
               CAST(extract(hour FROM created_at) AS INTEGER) AS event_hour,
               CASE WHEN event_type = 'VIEW' THEN 1 ELSE 0 END AS is_view,
               CASE WHEN event_type = 'CLICK' THEN 1 ELSE 0 END AS is_click,
               CASE WHEN event_type = 'PURCHASE' THEN 1 ELSE 0 END AS is_purchase
        FROM raw WHERE event_id IS NOT NULL
        """
    ),
    "product_metrics_day": _product_metrics(f"day = DATE '{DAY}'"),
    "product_metrics_daily": PRODUCT_METRICS_DAILY,
    "funnel_analysis": FUNNEL_ANALYSIS,
    "mart_product_metrics_daily": PRODUCT_METRICS_DAILY,
    "mart_funnel_analysis": FUNNEL_ANALYSIS,
    "funnel_day": _funnel_on(DAY),
    "funnel_empty_day": _funnel_on(EMPTY_DAY),
    "kpi_totals": _raw(
        f"""
        SELECT count(*) AS total_events, {V} AS total_views, {C} AS total_clicks,
               {P} AS total_purchases, {REVENUE_OR_0} AS total_revenue
        FROM raw
        """
    ),
    "events_per_sec": f"{_events_per_sec(10)} UNION ALL {_events_per_sec(3600)}",
    "latest_events": _latest("TRUE"),
    "latest_purchases": _latest("event_type = 'PURCHASE'"),
    "top_products_8": _raw(TOP_PRODUCTS),
    "batch_top5": _raw(
        f"""
        SELECT product_id, product_name, product_category AS category, {REVENUE} AS total_revenue
        FROM raw WHERE day = DATE '{DAY}' GROUP BY product_id, product_name, product_category
        ORDER BY total_revenue DESC NULLS LAST, product_id LIMIT 5
        """
    ),
    "funnel_overall": _raw(
        f"""
        SELECT greatest({V}, 1) AS views, {C} AS clicks, {P} AS purchases,
               {_percent(C, f'greatest({V}, 1)')} AS view_to_click_rate,
               {_percent(P, f'greatest({C}, 1)')} AS click_to_purchase_rate
        FROM raw
        """
    ),
    "category_breakdown": _raw(
        f"SELECT product_category AS category, {V} AS views, {P} AS purchases FROM raw GROUP BY 1"
    ),
    "top_products_revenue": _raw(
        f"""
        SELECT CAST(sum(CAST(revenue AS DECIMAL(20,2))) AS DOUBLE) AS top_products_revenue
        FROM ({TOP_PRODUCTS})
        """
    ),
    "revenue_on_day": _raw(
        f"""
        SELECT '{DAY}' AS event_date, {REVENUE_OR_0} AS revenue FROM raw WHERE day = DATE '{DAY}'
        """
    ),
    "batch_summary": _raw(
        f"""
        SELECT count(*) AS records_processed, {V} AS total_views, {P} AS total_purchases,
               {REVENUE_OR_0} AS total_revenue, {_percent(P, V)} AS conversion_pct
        FROM raw WHERE day = DATE '{DAY}'
        """
    ),
    "merge_add": _product_metrics(),
    "merge_replace": _product_metrics(
        f"day >= DATE '{REPLACE_FROM}' OR extract(hour FROM created_at) < 12"
    ),
    "upsert_funnel": _raw(
        f"""
        SELECT {_funnel_columns('CAST(day AS VARCHAR)')} FROM raw
        WHERE day = DATE '{DAY}' OR extract(hour FROM created_at) < 12 GROUP BY day
        """
    ),
    "route_topics": _log(
        """
        SELECT topic, CAST(product_id AS VARCHAR) AS key, CAST(event_id AS VARCHAR) AS event_id
        FROM log
        """
    ),
    "parse_events": _log(
        f"""
        SELECT CAST(event_id AS VARCHAR) AS event_id, event_type,
               CAST(product_id AS VARCHAR) AS product_id, product_name, product_category,
               CAST(product_price AS DOUBLE) AS product_price,
               CAST(user_id AS VARCHAR) AS user_id, strftime(created_at, {ISO}) AS created_at,
               event_id AS kafka_offset, part_no AS kafka_partition, topic AS kafka_topic
        FROM log
        """
    ),
    "rejected_events": _log(
        """
        SELECT topic AS kafka_topic, part_no AS kafka_partition, event_id AS kafka_offset,
               CASE event_id % 7
                 WHEN 0 THEN 'event_id missing; event_type missing; created_at missing'
                 WHEN 1 THEN 'created_at missing'
                 WHEN 2 THEN 'created_at missing'
                 WHEN 3 THEN 'event_id missing'
                 WHEN 4 THEN 'event_type longer than 20'
                 ELSE 'product_price out of range' END AS reject_reason
        FROM log WHERE event_id % 7 < 6
        """
    ),
    "dedup_events": _raw(
        f"""
        SELECT CAST(event_id AS VARCHAR) AS event_id, event_type,
               CAST(product_price AS DOUBLE) AS product_price,
               strftime(created_at, {ISO}) AS created_at, '{MAIN_TOPIC}' AS kafka_topic,
               event_id AS kafka_offset
        FROM raw WHERE day >= DATE '{SEEN_BEFORE}'
        """
    ),
    "topic_stats": _log(
        """
        SELECT topic AS topic_name, CAST(sum(n) AS BIGINT) AS message_count,
               max(last) AS last_offset, CAST(sum(span) AS BIGINT) AS offset_span
        FROM (SELECT topic, part_no, count(*) AS n, max(event_id) AS last,
                     max(event_id) - min(event_id) + 1 AS span
              FROM log GROUP BY topic, part_no)
        GROUP BY topic
        """
    ),
    "throughput_10s": _raw(
        f"""
        SELECT strftime(make_timestamp(slot * 10000000), {ISO}) AS window_start,
               strftime(make_timestamp((slot + 1) * 10000000), {ISO}) AS window_end,
               total_events, views, clicks, purchases, total_events / 10.0::DOUBLE AS events_per_sec
        FROM (SELECT epoch_us(created_at) // 10000000 AS slot, count(*) AS total_events,
                     {V} AS views, {C} AS clicks, {P} AS purchases FROM raw GROUP BY 1)
        """
    ),
    "retention_keep": _raw(
        f"""
        SELECT event_id, event_type, strftime(created_at, {ISO}) AS created_at
        FROM raw WHERE created_at >= TIMESTAMP '{CUTOFF}' OR created_at IS NULL
        """
    ),
    "retention_counts": f"""
        SELECT count(*) FILTER (ts < TIMESTAMP '{CUTOFF}') AS pruned,
               count(*) FILTER (ts IS NULL OR ts >= TIMESTAMP '{CUTOFF}') AS kept
        FROM events
    """,
    "dq_unique": _log(
        """
        SELECT CAST(event_id AS VARCHAR) AS event_id, count(*) AS copies
        FROM log GROUP BY event_id HAVING count(*) > 1
        """
    ),
    "dq_unique_metrics": _raw(
        """
        SELECT CAST(day AS VARCHAR) AS metric_date, product_id, count(*) AS copies
        FROM raw GROUP BY day, product_id HAVING count(*) > 1
        """
    ),
    "dq_not_null": _raw(
        """
        SELECT 'event_id' AS column_name, count(*) - count(event_id) AS null_rows FROM raw
        UNION ALL SELECT 'event_type', count(*) - count(event_type) FROM raw
        UNION ALL SELECT 'created_at', count(*) - count(created_at) FROM raw
        UNION ALL SELECT 'product_name', count(*) - count(product_name) FROM raw
        UNION ALL SELECT 'session_id', count(*) FROM raw
        """
    ),
    "dq_widths": _raw(
        """
        SELECT 'event_type' AS column_name,
               count(*) FILTER (length(event_type) > 5) AS failing_rows FROM raw
        UNION ALL SELECT 'product_name', count(*) FILTER (length(product_name) > 10) FROM raw
        UNION ALL SELECT 'product_price', count(*) FILTER (abs(product_price) >= 100) FROM raw
        """
    ),
    "dq_violations": _raw(
        """
        SELECT event_id, concat_ws('; ',
            CASE WHEN length(event_type) > 5 THEN 'event_type longer than 5' END,
            CASE WHEN length(product_name) > 10 THEN 'product_name longer than 10' END,
            CASE WHEN abs(product_price) >= 100 THEN 'product_price out of range' END) AS violations
        FROM raw
        WHERE length(event_type) > 5 OR length(product_name) > 10 OR abs(product_price) >= 100
        """
    ),
    "run_summary": _raw(
        """
        SELECT lower(event_type) AS dag_id,
               CASE WHEN event_type = 'ERROR' THEN 'failed' ELSE 'success' END AS status,
               count(*) AS runs, CAST(sum(n) AS BIGINT) AS records_processed,
               CAST(sum(seconds) AS BIGINT) AS total_seconds, max(seconds) AS max_seconds,
               CASE WHEN event_type = 'ERROR' THEN count(*) ELSE 0 END AS errors
        FROM (SELECT event_type, day, count(*) AS n,
                     (epoch_us(max(created_at)) - epoch_us(min(created_at))) // 1000000 AS seconds
              FROM raw GROUP BY event_type, day)
        GROUP BY event_type
        """
    ),
    "stream_raw": _raw(
        f"""
        SELECT CAST(event_id AS VARCHAR) AS event_id, event_type,
               CAST(product_id AS VARCHAR) AS product_id, product_name, product_category,
               CAST(product_price AS DOUBLE) AS product_price,
               CAST(user_id AS VARCHAR) AS user_id, strftime(created_at, {ISO}) AS created_at,
               CAST(day AS VARCHAR) AS event_date
        FROM raw
        """
    ),
}

_STREAMED = f"SELECT * REPLACE (CAST(product_id AS VARCHAR) AS product_id) FROM ({_product_metrics()})"
ORACLES["stream_product_metrics"] = _STREAMED
ORACLES["stream_replay"] = _STREAMED
ORACLES["store_raw"] = ORACLES["stream_raw"]
ORACLES["store_repeated"] = ORACLES["stream_raw"]
ORACLES["store_as_of"] = f"""
WITH batches AS (
  SELECT event_id, event_type, event_date,
         CASE WHEN event_type IN ('CLICK', 'PURCHASE')
              THEN least(CAST(event_id AS BIGINT) % 3, (CAST(event_id AS BIGINT) + 1) % 3)
              ELSE CAST(event_id AS BIGINT) % 3 END AS batch
  FROM ({ORACLES["stream_raw"]})
)
SELECT CAST(k AS INTEGER) AS as_of, event_id, event_type, event_date
FROM batches JOIN (SELECT unnest([0, 1, 2]) AS k) ON batch <= k
"""
ORACLES["store_metrics"] = _STREAMED
ORACLES["store_kpis"] = ORACLES["kpi_totals"]
ORACLES["store_top_products"] = ORACLES["top_products_8"]
ORACLES["store_funnel"] = ORACLES["funnel_overall"]
ORACLES["store_latest"] = ORACLES["latest_events"]
ORACLES["store_unique_metrics"] = f"""
SELECT metric_date, product_id, CAST(2 AS BIGINT) AS copies
FROM ({_STREAMED}) WHERE metric_date = '{DAY}'
"""
ORACLES["store_throughput"] = ORACLES["throughput_10s"]
ORACLES["store_total_kpis"] = ORACLES["kpi_totals"]
ORACLES["store_total_products"] = ORACLES["top_products_8"]
ORACLES["store_total_categories"] = ORACLES["category_breakdown"]
ORACLES["store_replayed"] = f"""
WITH sent AS (SELECT event_id, event_type, CAST(event_id AS BIGINT) % 7 = 5 AS wide
              FROM ({ORACLES["stream_raw"]}))
SELECT event_id, 'stored' AS state FROM sent WHERE NOT wide
UNION ALL SELECT event_id, 'rejected on product-events' FROM sent WHERE wide
UNION ALL SELECT event_id, 'rejected on product-clicks' FROM sent
          WHERE wide AND event_type = 'CLICK'
UNION ALL SELECT event_id, 'rejected on product-purchases' FROM sent
          WHERE wide AND event_type = 'PURCHASE'
"""
