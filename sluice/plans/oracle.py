"""The registered queries as DuckDB SQL over the given tables.

``CTES`` are named building blocks, ``FINALS`` the queries; a statement gets the blocks
it needs, found by name.
"""

from __future__ import annotations

import re

from sluice.schemas import (
    BUSINESS_KEY,
    CASCADE_EVIDENCE,
    ENTITY_ORDER,
    EXPECTED_SURFACE,
    FAILURE_KEYS,
    FAILURE_LINE_PREFIX,
    ORDER_REJECT_KEYS,
    ORDER_STATUSES,
    ORPHAN_ORDER_ID,
    PAYMENT_METHODS,
    PAYMENT_STATUSES,
    RECURRING_RULE,
)

PRIOR_TS = "TIMESTAMP '1999-01-01 00:00:00'"
DIM_PRIOR_TS = "TIMESTAMP '1994-06-01 00:00:00'"
RUN_TS = "TIMESTAMP '2024-06-01 00:00:00'"
EPOCH = "TIMESTAMP '1970-01-01 00:00:00'"
SINCE = "TIMESTAMP '2024-01-15 00:00:00'"
PKS = {
    "customers": "customer_id",
    "products": "product_id",
    "orders": "order_id",
    "payments": "payment_id",
}
WATERMARKS = {
    "customers": "created_at",
    "products": "created_at",
    "orders": "ordered_at",
    "payments": "paid_at",
}
BK = ", ".join(BUSINESS_KEY)


def _list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _array(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _days(expr: str) -> str:
    return f"to_days(CAST({expr} AS INTEGER))"


def _classify_orders(source: str) -> str:
    return f"""
    SELECT * EXCLUDE (dup_no),
      CASE WHEN customer_id IS NULL THEN 'missing_customer'
           WHEN quantity IS NULL OR quantity <= 0 THEN 'invalid_quantity'
           WHEN unit_price < 0 OR total_amount < 0 THEN 'negative_price'
           WHEN total_amount = 0 AND quantity * unit_price > 0 THEN 'destructive_fix'
           WHEN status IS NULL OR status NOT IN {_list(ORDER_STATUSES)} THEN 'malformed_data'
           WHEN dup_no > 1 THEN 'duplicate_order' END AS reject_rule,
      CASE WHEN customer_id IS NULL THEN 'customer_id is null (orphaned order)'
           WHEN quantity IS NULL OR quantity <= 0
             THEN 'quantity ' || coalesce(CAST(quantity AS VARCHAR), 'null') || ' violates quantity > 0'
           WHEN unit_price < 0 OR total_amount < 0
             THEN 'negative money: unit_price=' || coalesce(CAST(unit_price AS VARCHAR), 'null')
               || ' total_amount=' || coalesce(CAST(total_amount AS VARCHAR), 'null')
           WHEN total_amount = 0 AND quantity * unit_price > 0
             THEN 'total_amount=0 while quantity*unit_price=' || CAST(quantity * unit_price AS VARCHAR)
           WHEN status IS NULL OR status NOT IN {_list(ORDER_STATUSES)}
             THEN 'status ' || coalesce('''' || status || '''', 'null') || ' not in known ORDER_STATUSES'
           WHEN dup_no > 1 THEN 'duplicate of an earlier order on the full business key'
           END AS reject_reason
    FROM (SELECT *, row_number() OVER (PARTITION BY {BK} ORDER BY order_id) AS dup_no FROM {source})"""


def _classify_payments(silver_orders: str) -> str:
    return f"""
    SELECT b.*,
      CASE WHEN o.order_id IS NULL THEN 'orphan_payment'
           WHEN b.amount IS NULL OR b.amount < 0 THEN 'negative_price'
           WHEN b.status IS NULL OR b.status NOT IN {_list(PAYMENT_STATUSES)} THEN 'malformed_data'
           END AS reject_rule,
      CASE WHEN o.order_id IS NULL
             THEN 'order_id ' || coalesce(CAST(b.order_id AS VARCHAR), 'null') || ' has no accepted silver_orders match'
           WHEN b.amount IS NULL OR b.amount < 0
             THEN 'amount ' || coalesce(CAST(b.amount AS VARCHAR), 'null') || ' < 0'
           WHEN b.status IS NULL OR b.status NOT IN {_list(PAYMENT_STATUSES)}
             THEN 'status ' || coalesce('''' || b.status || '''', 'null') || ' not in known PAYMENT_STATUSES'
           END AS reject_reason
    FROM raw_payments b LEFT JOIN {silver_orders} o ON o.order_id = b.order_id"""


def _silver_orders(classified: str) -> str:
    return f"""
    SELECT order_id, customer_id, product_id, quantity, unit_price, total_amount, status, ordered_at,
      _ingested_at, _schema_drift, date_diff('day', ordered_at, _ingested_at) > 7 AS is_late
    FROM {classified} WHERE reject_rule IS NULL"""


def _silver_payments(classified: str) -> str:
    return f"""SELECT payment_id, order_id, method, amount, status, paid_at, _ingested_at
    FROM {classified} WHERE reject_rule IS NULL"""


def _required(*columns: str) -> str:
    return " OR ".join(f"{c} IS NULL OR trim({c}) = ''" for c in columns)


def _union(parts) -> str:
    return "\nUNION ALL\n".join(parts)


def _key_rows(keys) -> str:
    return _union(
        f"SELECT '{k}' AS failure_key, '{RECURRING_RULE.get(k, k)}' AS reject_rule, "
        f"'{EXPECTED_SURFACE[k]}' AS evidence_surface"
        for k in keys
    )


def _price(expr: str) -> str:
    return f"CAST({expr} AS DOUBLE)"


def _rollup(payments: str) -> str:
    return f"""
    SELECT order_id, method AS payment_method, status AS payment_status, amount AS payment_amount, paid_at
    FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY paid_at DESC, payment_id DESC) AS rn
      FROM {payments}) WHERE rn = 1"""


def _obt(orders: str, rollup: str) -> str:
    return f"""
    SELECT o.order_id, o.customer_id, c.country AS customer_country, c.city AS customer_city,
      c.segment AS customer_segment, o.product_id, p.sku AS product_sku, p.name AS product_name,
      p.category AS product_category, o.quantity, o.unit_price, o.total_amount, o.status, o.ordered_at,
      r.payment_method, r.payment_status, r.payment_amount, r.paid_at, o.is_late
    FROM {orders} o LEFT JOIN silver_customers c ON c.customer_id = o.customer_id
    LEFT JOIN silver_products p ON p.product_id = o.product_id LEFT JOIN {rollup} r ON r.order_id = o.order_id"""


def _daily(obt: str) -> str:
    return f"""
    SELECT order_date, product_category, count(*) AS order_count, CAST(sum(quantity) AS BIGINT) AS units_sold,
      sum(v) AS gross_revenue,
      CAST((2 * CAST(sum(v) * 100 AS BIGINT) + count(v)) // (2 * count(v)) AS BIGINT) AS avg_cents
    FROM (SELECT CAST(ordered_at AS DATE) AS order_date, product_category, quantity,
      CASE WHEN status IN ('cancelled', 'returned') THEN CAST(0 AS DECIMAL(12,2)) ELSE total_amount END AS v
      FROM {obt}) GROUP BY order_date, product_category"""


CTES: dict[str, str] = {
    # -- source entities ------------------------------------------------------------
    "raw_customers": f"""
    SELECT *, created_at + {_days("customer_id % 20")} AS _ingested_at, created_at AS _source_watermark
    FROM (SELECT c_custkey AS customer_id, c_name AS full_name, lower(c_name) || '@example.org' AS email,
      n_name AS country, r_name AS city,
      CASE WHEN c_custkey % 89 = 0 THEN '' ELSE c_mktsegment END AS segment,
      CASE WHEN c_custkey % 83 = 0 THEN TIMESTAMP '1999-01-01' ELSE TIMESTAMP '1993-01-01' END
        + {_days("c_custkey % 700")} AS created_at
      FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
      LEFT JOIN region ON n_regionkey = r_regionkey)""",
    "raw_products": f"""
    SELECT *, created_at + {_days("product_id % 20")} AS _ingested_at, created_at AS _source_watermark
    FROM (SELECT p_partkey AS product_id, p_brand || '-' || CAST(p_partkey AS VARCHAR) AS sku, p_name AS name,
      p_type AS category, CAST(p_retailprice AS DECIMAL(10,2)) AS unit_price,
      CASE WHEN p_partkey % 97 = 0 THEN CAST(-1 AS DECIMAL(10,2))
        ELSE CAST(CAST(p_retailprice AS DECIMAL(10,2)) * CAST(0.6 AS DECIMAL(2,1)) AS DECIMAL(10,2)) END AS cost,
      TIMESTAMP '1993-06-01' + {_days("p_partkey % 500")} AS created_at FROM part)""",
    "order_lines": """
    SELECT l_orderkey, min(l_partkey) AS product_id, CAST(sum(l_quantity) AS INTEGER) AS q
    FROM lineitem GROUP BY l_orderkey""",
    "order_base": """
    SELECT o_orderkey AS k, o_custkey, o_orderdate, l.product_id, l.q,
      CAST(p_retailprice AS DECIMAL(10,2)) AS price
    FROM orders LEFT JOIN order_lines l ON l.l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l.product_id""",
    "raw_orders": f"""
    SELECT 2 * k + copy AS order_id,
      CASE WHEN k % 101 <> 0 THEN o_custkey END AS customer_id, product_id,
      CASE WHEN k % 103 = 0 THEN -5 ELSE q END AS quantity,
      CAST(CASE WHEN k % 107 = 0 THEN -49.99 WHEN k % 139 <> 0 THEN price END AS DECIMAL(10,2)) AS unit_price,
      CAST(CASE WHEN k % 107 = 0 THEN -49.99 WHEN k % 109 = 0 THEN 0 ELSE q * price END AS DECIMAL(12,2)) AS total_amount,
      CASE WHEN k % 113 = 0 THEN '<script>' ELSE {_array(ORDER_STATUSES)}[1 + k % 5] END AS status,
      o_orderdate AS ordered_at, o_orderdate + {_days("k % 20")} AS _ingested_at,
      o_orderdate AS _source_watermark, k % 137 = 0 AS _schema_drift
    FROM (SELECT *, 0 AS copy FROM order_base UNION ALL SELECT *, 1 FROM order_base WHERE k % 127 = 0)""",
    "raw_payments": f"""
    SELECT payment_id, CASE WHEN payment_id % 131 = 0 THEN {ORPHAN_ORDER_ID} ELSE l_orderkey * 2 END AS order_id,
      {_array(PAYMENT_METHODS)}[1 + l_linenumber % 5] AS method,
      CAST(CASE WHEN payment_id % 199 = 0 THEN -1 ELSE price END AS DECIMAL(12,2)) AS amount,
      CASE WHEN payment_id % 197 = 0 THEN 'unknown' WHEN flag = 'A' THEN 'authorized'
        WHEN flag = 'N' THEN 'captured' ELSE 'refunded' END AS status,
      paid_at, paid_at + {_days("payment_id % 9")} AS _ingested_at, paid_at AS _source_watermark
    FROM (SELECT l_orderkey, l_linenumber, l_orderkey * 8 + l_linenumber AS payment_id,
      sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS price, max(l_returnflag) AS flag, max(l_shipdate) AS paid_at
      FROM lineitem GROUP BY l_orderkey, l_linenumber)""",
    # -- verdicts --------------------------------------------------------------------
    "cls_customers": f"""
    SELECT *, CASE WHEN customer_id IS NULL OR {_required("full_name", "email", "country", "segment")}
        THEN 'malformed_data' END AS reject_rule,
      CASE WHEN customer_id IS NULL THEN 'customer_id is null'
        {" ".join(f"WHEN {_required(c)} THEN '{c} is null/blank'" for c in ("full_name", "email", "country", "segment"))}
        END AS reject_reason FROM raw_customers""",
    "cls_products": f"""
    SELECT *, CASE WHEN product_id IS NULL OR {_required("sku", "category")} THEN 'malformed_data'
        WHEN unit_price IS NULL OR unit_price < 0 OR cost IS NULL OR cost < 0 THEN 'negative_price' END AS reject_rule,
      CASE WHEN product_id IS NULL THEN 'product_id is null'
        {" ".join(f"WHEN {_required(c)} THEN '{c} is null/blank'" for c in ("sku", "category"))}
        WHEN unit_price IS NULL OR unit_price < 0 THEN 'unit_price < 0 or null'
        WHEN cost IS NULL OR cost < 0 THEN 'cost < 0 or null' END AS reject_reason FROM raw_products""",
    "cls_orders": _classify_orders("raw_orders"),
    "cls_payments": _classify_payments("silver_orders"),
    "silver_customers": """
    SELECT customer_id, full_name, email, country, city, segment, created_at, _ingested_at
    FROM cls_customers WHERE reject_rule IS NULL""",
    "silver_products": """
    SELECT product_id, sku, name, category, unit_price, cost, created_at, _ingested_at
    FROM cls_products WHERE reject_rule IS NULL""",
    "silver_orders": _silver_orders("cls_orders"),
    "silver_payments": _silver_payments("cls_payments"),
    # -- a second drop of orders -------------------------------------------------------
    "first_raw": f"SELECT * FROM raw_orders WHERE _ingested_at < {PRIOR_TS}",
    "first_high": "SELECT max(ordered_at) AS hts, max(order_id) AS hid FROM first_raw",
    "second_batch": f"""
    SELECT order_id, customer_id, product_id, quantity, unit_price,
      CASE WHEN order_id % 7 = 0 THEN CAST(0 AS DECIMAL(12,2)) ELSE total_amount END AS total_amount,
      status, ordered_at, {RUN_TS} AS _ingested_at, {RUN_TS} AS _source_watermark, _schema_drift
    FROM raw_orders, first_high
    WHERE ordered_at >= hts - INTERVAL 7 DAY OR order_id > hid OR order_id >= hid - 1000""",
    "second_raw": """
    SELECT * FROM first_raw WHERE order_id NOT IN (SELECT order_id FROM second_batch)
    UNION ALL SELECT * FROM second_batch""",
    "cls_first": _classify_orders("first_raw"),
    "cls_second": _classify_orders("second_raw"),
    "silver_first": _silver_orders("cls_first"),
    "silver_second": _silver_orders("cls_second"),
    "cls_payments_first": _classify_payments("silver_first"),
    "cls_payments_second": _classify_payments("silver_second"),
    # -- gold ----------------------------------------------------------------------------
    "rollup": _rollup("silver_payments"),
    "obt": _obt("silver_orders", "rollup"),
    "daily": _daily("obt"),
    "silver_payments_second": _silver_payments("cls_payments_second"),
    "rollup_second": _rollup("silver_payments_second"),
    "obt_second": _obt("silver_second", "rollup_second"),
    "daily_second": _daily("obt_second"),
    "realised": """
    SELECT *, CASE WHEN status IN ('cancelled', 'returned') THEN CAST(0 AS DECIMAL(12,2)) ELSE total_amount END AS v
    FROM obt""",
    # -- evidence ----------------------------------------------------------------------------
    "order_rejects": "SELECT * FROM cls_orders WHERE reject_rule IS NOT NULL",
    "payment_rejects": "SELECT * FROM cls_payments WHERE reject_rule IS NOT NULL",
    "reject_found": f"""
    SELECT k.failure_key, k.reject_rule, k.evidence_surface, count(r.pk) AS n
    FROM (SELECT 'o' AS side, * FROM ({_key_rows(ORDER_REJECT_KEYS)})
      UNION ALL SELECT 'p' AS side, * FROM ({_key_rows(("orphan_payment",))})) k
    LEFT JOIN (SELECT 'o' AS side, order_id AS pk, reject_rule FROM order_rejects
      UNION ALL SELECT 'p', payment_id, reject_rule FROM payment_rejects) r
    ON r.side = k.side AND r.reject_rule = k.reject_rule GROUP BY ALL""",
    "flags": f"""
    SELECT 'late_arrival' AS failure_key, '{EXPECTED_SURFACE["late_arrival"]}' AS evidence_surface,
      count(*) FILTER (WHERE is_late) AS n FROM silver_orders
    UNION ALL SELECT 'schema_drift', '{EXPECTED_SURFACE["schema_drift"]}',
      count(*) FILTER (WHERE _schema_drift) FROM silver_orders""",
    "minutes": """
    SELECT date_trunc('minute', ordered_at) AS m, count(*) AS c FROM silver_orders GROUP BY 1""",
    "spike": """
    SELECT CAST(coalesce(sum(c), 0) AS BIGINT) AS total_rows, coalesce(max_by(c, m), 0) AS latest,
      CAST(coalesce(median(c), 0) AS DOUBLE) AS med, count(*) AS minutes FROM minutes""",
    "sweep": """
    SELECT failure_key, evidence_surface, n > 0 AS found, n AS count FROM reject_found
    UNION ALL SELECT failure_key, evidence_surface, n > 0, n FROM flags
    UNION ALL SELECT 'volume_spike', 'silver_orders.count', latest > greatest(med * 10, 200), latest FROM spike""",
    "leaks": f"""
    SELECT 'negative_price' AS failure_key, count(*) FILTER (WHERE unit_price < 0 OR total_amount < 0) AS leaked FROM obt
    UNION ALL SELECT 'missing_customer', count(*) FILTER (WHERE customer_id IS NULL) FROM obt
    UNION ALL SELECT 'invalid_quantity', count(*) FILTER (WHERE quantity <= 0) FROM obt
    UNION ALL SELECT 'destructive_fix', count(*) FILTER (WHERE total_amount = 0 AND quantity * unit_price > 0) FROM obt
    UNION ALL SELECT 'malformed_data', count(*) FILTER (WHERE status NOT IN {_list(ORDER_STATUSES)}) FROM obt
    UNION ALL SELECT 'orphan_payment', count(*) FILTER (WHERE order_id = {ORPHAN_ORDER_ID}) FROM obt
    UNION ALL SELECT 'duplicate_order', count(*) FROM (SELECT 1 FROM obt GROUP BY {BK} HAVING count(*) > 1)""",
    # -- incidents ------------------------------------------------------------------------------
    "ledger": f"""
    SELECT event_id AS incident_id, {_array(FAILURE_KEYS)}[1 + event_id % 14] AS failure_key,
      'seen for user ' || CAST(user_id AS VARCHAR) AS detail,
      ['Data Profiler', 'Pipeline Watch', 'Manager'][1 + user_id % 3] AS detected_by, ts AS injected_at,
      epoch_us(ts) // 600000000 AS window_id
    FROM events WHERE event_type = 'error'""",
    "truth": """
    SELECT window_id AS w, list_sort(list_distinct(list(failure_key))) AS keys,
      last(failure_key ORDER BY injected_at, incident_id) AS last_key, count(*) AS incidents
    FROM ledger GROUP BY window_id""",
    "diagnoses": """
    SELECT d.window_id, t.last_key, t.keys, t.incidents, t.w,
      CASE d.window_id % 6 WHEN 1 THEN CASE t.last_key WHEN 'negative_price' THEN 'recurring_incident'
          WHEN 'recurring_incident' THEN 'negative_price' ELSE 'late_arrival' END
        WHEN 2 THEN 'multi_failure_cascade' WHEN 3 THEN 'schema_drift' WHEN 4 THEN NULL
        ELSE coalesce(t.last_key, 'slow_source') END AS failure_key,
      CASE WHEN d.window_id % 6 = 2 THEN ['missing_customer', 'volume_spike', 'negative_price'] ELSE [] END AS named,
      CASE d.window_id % 6 WHEN 5 THEN s WHEN 0 THEN s WHEN 1 THEN '' ELSE 'silver_orders_rejects' END AS surface
    FROM (SELECT DISTINCT epoch_us(ts) // 600000000 AS window_id FROM events) d
    LEFT JOIN (SELECT *, CASE last_key WHEN 'orphan_payment' THEN 'silver_payments_rejects'
      WHEN 'late_arrival' THEN 'silver_orders.is_late' ELSE 'silver_orders_rejects' END AS s FROM truth) t
    ON t.w = d.window_id""",
    "surfaces": _union(
        f"SELECT '{k}' AS key, '{v}' AS expected" for k, v in EXPECTED_SURFACE.items()
    ),
    "tiered": """
    SELECT d.*, s.expected, len(keys) - CASE WHEN list_contains(keys, 'multi_failure_cascade') THEN 1 ELSE 0 END AS n_members,
      len(list_intersect(keys, named)) AS n_overlap,
      CASE WHEN failure_key IS NULL OR w IS NULL THEN 'no-run'
        WHEN list_contains(keys, 'multi_failure_cascade') OR failure_key = 'multi_failure_cascade' THEN 'cascade'
        WHEN failure_key = last_key THEN 'exact'
        WHEN (failure_key = 'recurring_incident' AND last_key = 'negative_price')
          OR (failure_key = 'negative_price' AND last_key = 'recurring_incident') THEN 'alias'
        ELSE 'miss' END AS tier
    FROM diagnoses d LEFT JOIN surfaces s ON s.key = d.last_key""",
    "graded": """
    SELECT *, CASE WHEN diagnosis_score >= 1 THEN 'correct' ELSE 'incorrect' END AS label FROM (
    SELECT window_id, failure_key AS diagnosed, tier,
      CASE WHEN tier = 'cascade' THEN 'multi_failure_cascade' WHEN tier = 'no-run' THEN '' ELSE last_key END AS matched,
      CASE tier WHEN 'cascade' THEN round(0.5::DOUBLE + 0.5::DOUBLE *
          CASE WHEN n_members > 0 THEN n_overlap::DOUBLE / n_members ELSE 0 END, 4)
        WHEN 'exact' THEN 1.0::DOUBLE WHEN 'alias' THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END AS diagnosis_score,
      CASE WHEN tier IN ('exact', 'alias', 'miss') AND expected IS NOT NULL AND trim(surface) = expected
        THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS evidence_score,
      CAST(CASE WHEN tier = 'cascade' THEN n_overlap ELSE 0 END AS INTEGER) AS overlap,
      CAST(CASE WHEN tier = 'cascade' THEN n_members ELSE 0 END AS INTEGER) AS members,
      CASE WHEN tier = 'no-run' THEN 0 ELSE incidents END AS oracle_incidents FROM tiered)""",
    "timed": """
    SELECT window_id, failure_key, named, coalesce(surface, 'silver_orders_rejects') AS surface,
      to_timestamp(window_id * 600 - 780)::TIMESTAMP AS span_start,
      to_timestamp(window_id * 600 - 780 + (window_id % 51 + 1) * 420)::TIMESTAMP AS span_end FROM diagnoses""",
    "span_truth": """
    SELECT window_id AS w, list_sort(list_distinct(list(l.failure_key))) AS keys,
      last(l.failure_key ORDER BY injected_at, incident_id) AS last_key, count(*) AS incidents
    FROM timed JOIN (SELECT incident_id, failure_key, injected_at FROM ledger) l
      ON injected_at >= span_start AND injected_at < span_end GROUP BY window_id""",
    "span_diagnoses": """
    SELECT window_id, failure_key, named, surface, keys, last_key, incidents, w
    FROM timed LEFT JOIN span_truth ON w = window_id""",
    "routed": """
    SELECT d.window_id, coalesce(keys, []) AS keys, coalesce(incidents, 0) AS incidents, last_key,
      CASE WHEN coalesce(incidents, 0) = 0 THEN 'no-run'
        WHEN list_contains(keys, 'multi_failure_cascade') OR len(keys) > 1 THEN 'cascade' ELSE 'base' END AS route
    FROM (SELECT DISTINCT epoch_us(ts) // 600000000 AS window_id FROM events) d LEFT JOIN truth ON w = d.window_id""",
    "log_parsed": f"""
    SELECT event_id AS seq, 'r-' || CAST(user_id AS VARCHAR) AS run_id, 'backbone' AS job,
      'step failed: code=' || CAST(event_id % 100 AS VARCHAR) || ' props ' || trim(props) AS error,
      '{FAILURE_LINE_PREFIX}' AS prefix
    FROM events WHERE event_type = 'error'""",
    "node_failures": """
    SELECT document_id, node, lower(status) AS status, message FROM (
      SELECT event_id AS document_id, 'model.' || event_type AS node,
        ['success', 'Error', 'fail', 'SKIPPED', 'runtime error', 'pass'][1 + event_id % 6] AS status,
        'user ' || CAST(user_id AS VARCHAR) AS message FROM events WHERE event_id % 17 <> 0)
    WHERE lower(status) IN ('error', 'fail', 'runtime error', 'skipped')""",
    # -- history ----------------------------------------------------------------------------------
    "whole_past": f"""
    SELECT *, list_distinct(regexp_extract_all(lower(failure_key || ' ' || detail), '[a-z0-9_]+')) AS toks
    FROM (SELECT item_id AS incident_id, {_array(FAILURE_KEYS)}[1 + item_id % 14] AS failure_key, text AS detail
      FROM benchmark)""",
    "past": f"""
    SELECT *, list_distinct(regexp_extract_all(lower(failure_key || ' ' || detail), '[a-z0-9_]+')) AS toks
    FROM (SELECT item_id AS incident_id, {_array(FAILURE_KEYS)}[1 + item_id % 14] AS failure_key, text AS detail,
      row_number() OVER (ORDER BY item_id DESC) AS recency FROM benchmark) WHERE recency <= 200""",
    "asked": """
    SELECT doc_id AS query_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS toks FROM documents""",
    "shared_tokens": """
    SELECT query_id, recency, incident_id, failure_key, n, m, count(*) AS overlap
    FROM (SELECT query_id, len(toks) AS n, unnest(toks) AS t FROM asked) a
    JOIN (SELECT recency, incident_id, failure_key, len(toks) AS m, unnest(toks) AS t FROM past) p USING (t)
    GROUP BY ALL""",
    "ranked_past": """
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, recency) AS rank
    FROM (SELECT *, overlap::DOUBLE / (n + m - overlap) AS score FROM shared_tokens)""",
    "reports": """
    SELECT 'd' || CAST(doc_id AS VARCHAR) AS report_id, CASE WHEN doc_id % 11 = 0 THEN '' ELSE source END AS ikey,
      CASE WHEN doc_id % 7 = 0 THEN 'too short' ELSE text END AS cause, lang AS evidence,
      CASE WHEN doc_id % 13 = 0 THEN 'dump 0x00 follows' ELSE source END AS fix, text AS note FROM documents
    UNION ALL SELECT 'p' || CAST(page_id AS VARCHAR), CASE WHEN page_id % 11 = 0 THEN '' ELSE url END,
      CASE WHEN page_id % 7 = 0 THEN 'too short' ELSE url END, html,
      CASE WHEN page_id % 13 = 0 THEN 'dump 0x00 follows' ELSE url END, url FROM pages""",
    # -- service levels -----------------------------------------------------------------------------
    "lags": """
    SELECT order_id, ordered_at AS injected_at, order_id % 90 * 1.5::DOUBLE AS ingest_s,
      order_id % 240 * 1.0::DOUBLE AS build_s, order_id % 30 * 0.5::DOUBLE AS gold_wait_s, visible_at,
      (epoch_us(visible_at) - epoch_us(ordered_at)) / 1000000.0::DOUBLE AS end_to_end_lag_s,
      visible_at IS NOT NULL AS visible
    FROM raw_orders LEFT JOIN (SELECT order_id, min(paid_at) AS visible_at FROM raw_payments GROUP BY 1) USING (order_id)""",
    "samples": """
    SELECT *, CASE WHEN outcome = 'ok' THEN user_id % 25 + 1 ELSE 0 END AS rows_committed FROM (
    SELECT user_id, event_type AS role, user_id % 4 AS worker, value AS latency_ms,
      CASE WHEN user_id % 17 = 0 THEN 'timeout' WHEN user_id % 13 = 0 THEN 'error' ELSE 'ok' END AS outcome,
      date_trunc('hour', ts) AS run_id FROM events)""",
    "tally": """
    SELECT role, worker, count(*) FILTER (WHERE outcome = 'ok') AS operations,
      count(*) FILTER (WHERE outcome = 'error') AS errors, count(*) FILTER (WHERE outcome = 'timeout') AS timeouts,
      CAST(sum(rows_committed) AS BIGINT) AS rows_committed, max(latency_ms) FILTER (WHERE outcome = 'ok') AS max_ms
    FROM samples GROUP BY role, worker""",
    "ok_sorted": """
    SELECT role, latency_ms, row_number() OVER (PARTITION BY role ORDER BY latency_ms) - 1 AS i,
      count(*) OVER (PARTITION BY role) AS n FROM samples WHERE outcome = 'ok'""",
    "all_sorted": """
    SELECT role, latency_ms, row_number() OVER (PARTITION BY role ORDER BY latency_ms) - 1 AS i,
      count(*) OVER (PARTITION BY role) AS n
    FROM (SELECT role, latency_ms FROM samples UNION ALL SELECT '*', latency_ms FROM samples)""",
    "activity": """
    SELECT sampled_at, pid, CASE WHEN kind < 'e' THEN 'dagster_ingest' WHEN kind < 's' THEN 'oltp_writer'
      ELSE 'console' END AS app, CASE WHEN first_id % 3 <> 0 THEN 'Lock' ELSE 'Client' END AS wait_event_type,
      'transactionid' AS wait_event, 'update orders set status = ' || kind AS query, [pid + 1, pid + 2, pid + 7] AS blockers
    FROM (SELECT date_trunc('hour', ts) AS sampled_at, user_id AS pid, min(event_type) AS kind, min(event_id) AS first_id
      FROM events GROUP BY 1, 2)""",
    "edges": """
    SELECT w.sampled_at, w.pid AS waiter_pid, w.app AS waiter_app, b.pid AS blocker_pid, b.app AS blocker_app,
      w.wait_event_type, w.wait_event, left(w.query, 200) AS waiter_query, w.query AS waiter_text,
      w.app = 'oltp_writer' AND b.app = 'dagster_ingest' AS analytics_attributable
    FROM (SELECT *, unnest(blockers) AS blocked_by FROM activity WHERE wait_event_type = 'Lock') w
    JOIN activity b ON b.sampled_at = w.sampled_at AND b.pid = w.blocked_by""",
}

# The same grading over spans of time.
CTES["span_tiered"] = CTES["tiered"].replace("FROM diagnoses d", "FROM span_diagnoses d")
CTES["span_graded"] = CTES["graded"].replace("FROM tiered)", "FROM span_tiered)")


def _intent(keys: str, measures: str, source: str, order: str, limit: int, where: str = "") -> str:
    return f"SELECT {keys}, {measures} FROM {source} {where} GROUP BY {keys} ORDER BY {order} LIMIT {limit}"


ROLLUP_SUMS = (
    "CAST(sum(order_count) AS BIGINT) AS order_count, CAST(sum(units_sold) AS BIGINT) AS units_sold, "
    f"{_price('sum(gross_revenue)')} AS gross_revenue"
)
PRODUCT_SUMS = (
    "count(*) AS order_count, CAST(sum(quantity) AS BIGINT) AS units_sold, "
    f"{_price('sum(v)')} AS gross_revenue"
)
PRODUCT_KEYS = "product_sku, product_name, product_category"
COUNTRY_SUMS = f"count(*) AS order_count, {_price('sum(v)')} AS gross_revenue"
STATUS_SUMS = (
    f"count(*) AS order_count, {_price('sum(total_amount)')} AS total_amount, "
    "count(*) FILTER (WHERE is_late) AS late_count"
)
BY_REVENUE = "gross_revenue DESC NULLS LAST"
WINDOW = "BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'"


def _by_period(limit: int, where: str = "") -> str:
    inner = _intent("order_date", ROLLUP_SUMS, "daily", "order_date DESC NULLS LAST", limit, where)
    return f"SELECT * REPLACE (CAST(order_date AS VARCHAR) AS order_date) FROM ({inner})"


def _by_category(limit: int, where: str = "") -> str:
    order = f"{BY_REVENUE}, product_category ASC NULLS LAST"
    return _intent("product_category", ROLLUP_SUMS, "daily", order, limit, where)


def _by_country(limit: int, where: str = "") -> str:
    order = f"{BY_REVENUE}, customer_country ASC NULLS LAST"
    return _intent("customer_country", COUNTRY_SUMS, "realised", order, limit, where)


def _top_products(limit: int, first: str = "gross_revenue") -> str:
    ties = ", ".join(f"{k} ASC NULLS LAST" for k in PRODUCT_KEYS.split(", "))
    return _intent(PRODUCT_KEYS, PRODUCT_SUMS, "realised", f"{first} DESC NULLS LAST, {ties}", limit)


def _by_status(limit: int) -> str:
    order = "order_count DESC NULLS LAST, status ASC NULLS LAST"
    return _intent("status", STATUS_SUMS, "obt", order, limit)


def _section(name: str, inner: str, order: str, label: str, amount: str = "gross_revenue") -> str:
    return f"""SELECT '{name}' AS section, CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS rank,
      {label} AS label, order_count, {amount} AS amount FROM ({inner})"""


PRODUCT_LABEL = "concat_ws(' / ', product_sku, product_name, product_category)"
PRODUCT_ORDER = f"{BY_REVENUE}, product_sku NULLS LAST, product_name NULLS LAST, product_category NULLS LAST"

MONEY_ORDER = "* REPLACE (CAST(unit_price AS DOUBLE) AS unit_price, CAST(total_amount AS DOUBLE) AS total_amount)"


def _money(source: str, *columns: str) -> str:
    swaps = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in columns)
    return f"SELECT * REPLACE ({swaps}) FROM {source}"


MONEY = {
    "customers": (),
    "products": ("unit_price", "cost"),
    "orders": ("unit_price", "total_amount"),
    "payments": ("amount",),
}


def _all(source: str, entity: str) -> str:
    return _money(source, *MONEY[entity]) if MONEY[entity] else f"SELECT * FROM {source}"


def _window(entity: str, prior_ts: str, pk_arms: bool) -> str:
    pk, wm = PKS[entity], WATERMARKS[entity]
    arms = f"{wm} >= hts - INTERVAL 7 DAY AS recent_time"
    test = "recent_time"
    if pk_arms:
        arms += f", {pk} > hid AS new_key, {pk} >= hid - 1000 AS recent_key"
        test += " OR new_key OR recent_key"
    return f"""SELECT * FROM (SELECT {pk}, {wm}, {arms} FROM raw_{entity},
      (SELECT max({wm}) AS hts, max({pk}) AS hid FROM raw_{entity} WHERE {wm} < {prior_ts})) WHERE {test}"""


def _high(entity: str) -> str:
    return f"""SELECT '{entity}' AS entity, max({WATERMARKS[entity]}) AS high_ts, max({PKS[entity]}) AS high_id
      FROM raw_{entity}"""


def _picked(source: str, spot: str, name: str) -> str:
    """Value at a 0-based position of each sorted group."""
    return f"max(latency_ms) FILTER (WHERE i = {spot}) AS {name}"


def _interpolated(p: str, name: str) -> str:
    lo = f"max(latency_ms) FILTER (WHERE i = CAST(floor((n - 1) * {p}::DOUBLE) AS BIGINT))"
    hi = f"max(latency_ms) FILTER (WHERE i = least(CAST(floor((n - 1) * {p}::DOUBLE) AS BIGINT) + 1, n - 1))"
    part = f"max((n - 1) * {p}::DOUBLE - floor((n - 1) * {p}::DOUBLE))"
    return f"round(({lo} + ({hi} - {lo}) * {part}) * 100) / 100 AS {name}"


def _nearest(p: int, name: str) -> str:
    spot = f"greatest(0, least(n - 1, CAST(round_even({p / 100.0}::DOUBLE * n + 0.5::DOUBLE, 0) AS BIGINT) - 1))"
    return f"round(max(latency_ms) FILTER (WHERE i = {spot}) * 100) / 100 AS {name}"


def _three(expr: str, name: str) -> str:
    return f"coalesce(round({expr} * 1000) / 1000, 0.0::DOUBLE) AS {name}"


def _audit(rule: str, source: str, scope: str, broken: str) -> str:
    return f"""SELECT '{rule}' AS rule, count(*) FILTER (WHERE {scope}) AS checked,
      count(*) FILTER (WHERE ({scope}) AND ({broken})) AS violations FROM {source}"""


def _unique(rule: str, source: str, col: str) -> str:
    return f"""SELECT '{rule}' AS rule, CAST(sum(n) AS BIGINT) AS checked, count(*) FILTER (WHERE n > 1) AS violations
      FROM (SELECT count(*) AS n FROM {source} WHERE {col} IS NOT NULL GROUP BY {col})"""


def _marks(col: str) -> str:
    return " OR ".join(
        f"contains(lower({col}), {m})" for m in ("'<script>'", "'0x00'", "chr(0)", "'�'")
    )


def _logged(run: str, full: str, where: dict[str, str]) -> str:
    parts = []
    for e in ENTITY_ORDER:
        pk, wm = PKS[e], WATERMARKS[e]
        parts.append(
            f"""SELECT {run} AS run_ts, '{e}' AS entity, count(*) AS rows_read, count(*) AS rows_upserted,
            (SELECT count(*) FROM raw_{e}) AS table_total, {full} AS full_load, false AS schema_drift,
            CAST((SELECT max({wm}) FROM raw_{e}) AS VARCHAR) AS high_watermark_ts,
            CAST((SELECT max({pk}) FROM raw_{e}) AS VARCHAR) AS high_watermark_id FROM raw_{e} {where[e]}"""
        )
    return _union(parts)


def _second_window(entity: str) -> str:
    pk, wm = PKS[entity], WATERMARKS[entity]
    test = f"{wm} >= (SELECT max({wm}) FROM raw_{entity}) - INTERVAL 7 DAY"
    if entity in ("orders", "payments"):
        test += f" OR {pk} >= (SELECT max({pk}) FROM raw_{entity}) - 1000"
    return f"WHERE {test}"


def _count_rows(name: str, source: str) -> str:
    return f"SELECT '{name}' AS table_name, count(*) AS rows FROM {source}"


TABLE_COUNTS = _union(
    [
        *[_count_rows(f"silver_{e}", f"silver_{e}") for e in ENTITY_ORDER],
        *[
            _count_rows(f"silver_{e}_rejects", f"cls_{e} WHERE reject_rule IS NOT NULL")
            for e in ENTITY_ORDER
        ],
        _count_rows("gold_orders_obt", "obt"),
        _count_rows("gold_revenue_daily", "daily"),
    ]
)

DAILY_OUT = """CAST(order_date AS VARCHAR) AS order_date, product_category, order_count, units_sold"""

OBT_COLUMNS = (
    "order_id bigint, customer_id bigint, customer_country string, customer_city string, "
    "customer_segment string, product_id bigint, product_sku string, product_name string, "
    "product_category string, quantity int, unit_price decimal(10,2), "
    "total_amount decimal(12,2), status string, ordered_at timestamp, payment_method string, "
    "payment_status string, payment_amount decimal(12,2), paid_at timestamp, is_late boolean"
)
DAILY_COLUMNS = (
    "order_date date, product_category string, order_count bigint, units_sold bigint, "
    "gross_revenue decimal(22,2), avg_order_value decimal(12,2)"
)

FRESH_MEDIANS = ", ".join(
    _three(f"median({c}) FILTER (WHERE visible)", f"median_{c}")
    for c in ("ingest_s", "build_s", "gold_wait_s")
)

FINALS: dict[str, str] = {
    # -- ingest
    "ingest_scan": f"""SELECT order_id, customer_id, product_id, quantity, {_price("unit_price")} AS unit_price,
      {_price("total_amount")} AS total_amount, status, ordered_at FROM raw_orders""",
    "ingest_window_orders": _window("orders", PRIOR_TS, True),
    "ingest_window_payments": _window("payments", PRIOR_TS, True),
    "ingest_window_customers": _window("customers", DIM_PRIOR_TS, False),
    "ingest_schema_drift": "SELECT order_id, customer_id, true AS _schema_drift FROM raw_orders",
    "ingest_mixed_drift": """SELECT order_id, customer_id, order_id % 3 = 0 AS _schema_drift FROM raw_orders""",
    "ingest_drift_files": """SELECT CASE WHEN order_id % 3 = 0 THEN 'user_id' ELSE 'customer_id' END AS live,
      order_id % 3 = 0 AS _schema_drift, count(*) AS rows FROM raw_orders GROUP BY ALL""",
    "ingest_last_write": f"""SELECT order_id, CASE WHEN order_id % 5 = 0 THEN 'delivered' WHEN order_id % 7 = 0 THEN 'returned'
      ELSE status END AS status FROM raw_orders""",
    "ingest_stamp": f"""SELECT order_id, {RUN_TS} AS _ingested_at,
      (SELECT max(ordered_at) FROM raw_orders) AS _source_watermark, false AS _schema_drift FROM raw_orders""",
    "ingest_high_watermark": _union(_high(e) for e in ENTITY_ORDER),
    "watermark_state": "SELECT entity, high_ts AS prior_ts, high_id AS prior_id FROM ("
    + _union(_high(e) for e in ENTITY_ORDER)
    + ")",
    "ingest_upsert": f"""SELECT order_id, {_price("total_amount")} AS total_amount, status, _ingested_at
      FROM second_raw""",
    "ingest_load_stats": """SELECT 'orders' AS entity, (SELECT count(*) FROM second_batch) AS rows_read,
      (SELECT count(*) FROM second_batch) AS rows_upserted, (SELECT count(*) FROM second_raw) AS table_total,
      false AS full_load, false AS schema_drift""",
    "ingest_run": _logged(PRIOR_TS, "true", {e: "" for e in ENTITY_ORDER})
    + "\nUNION ALL\n"
    + _logged(RUN_TS, "false", {e: _second_window(e) for e in ENTITY_ORDER}),
    "purge_keys": "SELECT order_id, status FROM raw_orders WHERE status <> 'cancelled'",
    "purge_orphans": """SELECT payment_id, order_id FROM raw_payments
      WHERE order_id IN (SELECT order_id FROM raw_orders)""",
    "sample_k": f"""SELECT order_id, customer_id, product_id, quantity, {_price("unit_price")} AS unit_price,
      {_price("total_amount")} AS total_amount, status, ordered_at FROM raw_orders ORDER BY md5(CAST(order_id AS VARCHAR) || '|7'), order_id LIMIT 100""",
    "latest_n": f"""SELECT order_id, customer_id, product_id, quantity, {_price("unit_price")} AS unit_price,
      {_price("total_amount")} AS total_amount, status, ordered_at FROM raw_orders ORDER BY order_id DESC LIMIT 500""",
    "write_layers": TABLE_COUNTS,
    # -- classification
    **{f"bronze_{e}": _all(f"raw_{e}", e) for e in ENTITY_ORDER},
    **{
        f"classify_{e}": f"SELECT {PKS[e]}, reject_rule, reject_reason FROM cls_{e}"
        for e in ENTITY_ORDER
    },
    "dedupe_business_key": f"""SELECT order_id, row_number() OVER (PARTITION BY {BK} ORDER BY order_id) > 1
      AS duplicate FROM raw_orders""",
    "domain_check": f"""SELECT 'orders' AS entity, status, status IN {_list(ORDER_STATUSES)} AS known,
      count(*) AS rows FROM raw_orders GROUP BY ALL
      UNION ALL SELECT 'payments', status, status IN {_list(PAYMENT_STATUSES)}, count(*) FROM raw_payments GROUP BY ALL""",
    **{f"silver_{e}": _all(f"silver_{e}", e) for e in ENTITY_ORDER},
    "late_flag": """SELECT order_id, date_diff('day', ordered_at, _ingested_at) > 7 AS is_late FROM raw_orders""",
    **{
        f"rejects_{e}": f"SELECT *, {RUN_TS} AS rejected_at FROM ({_all(f'cls_{e}', e)}) WHERE reject_rule IS NOT NULL"
        for e in ENTITY_ORDER
    },
    "split_invariant": _union(
        f"""SELECT '{e}' AS entity, (SELECT count(*) FROM raw_{e}) AS bronze_rows,
        (SELECT count(*) FROM silver_{e}) AS accepted_rows,
        (SELECT count(*) FROM cls_{e} WHERE reject_rule IS NOT NULL) AS rejected_rows,
        (SELECT count(*) FROM silver_{e} s JOIN (SELECT {PKS[e]} AS pk FROM cls_{e} WHERE reject_rule IS NOT NULL) r
          ON r.pk = s.{PKS[e]}) AS overlap,
        (SELECT count(*) FROM raw_{e}) = (SELECT count(*) FROM silver_{e})
          + (SELECT count(*) FROM cls_{e} WHERE reject_rule IS NOT NULL) AS holds"""
        for e in ENTITY_ORDER
    ),
    "reject_histogram": _union(
        f"""SELECT '{e}' AS entity, reject_rule, count(*) AS rows,
        count(*) FILTER (WHERE reject_reason IS NULL OR trim(reject_reason) = '') AS blank_reasons
        FROM cls_{e} WHERE reject_rule IS NOT NULL GROUP BY reject_rule"""
        for e in ENTITY_ORDER
    ),
    "baseline_audit": _union(
        [
            _audit(
                "cost_45_to_80_percent",
                "raw_products",
                "cost IS NOT NULL AND unit_price IS NOT NULL",
                "NOT (cost * 100 >= unit_price * 45 AND cost * 100 <= unit_price * 80)",
            ),
            _audit(
                "signup_before_order",
                "raw_orders o LEFT JOIN raw_customers c ON c.customer_id = o.customer_id",
                "c.created_at IS NOT NULL",
                "c.created_at > o.ordered_at",
            ),
            _audit(
                "total_is_price_times_quantity",
                "raw_orders",
                "total_amount IS NOT NULL AND unit_price IS NOT NULL AND quantity IS NOT NULL",
                "total_amount <> unit_price * quantity",
            ),
            _audit(
                "order_before_payment",
                "raw_payments p LEFT JOIN raw_orders o ON o.order_id = p.order_id",
                "o.ordered_at IS NOT NULL",
                "o.ordered_at > p.paid_at",
            ),
            _audit(
                "returned_is_refunded",
                "raw_payments p LEFT JOIN raw_orders o ON o.order_id = p.order_id",
                "o.status = 'returned'",
                "p.status <> 'refunded'",
            ),
            _unique("email_is_unique", "raw_customers", "email"),
            _unique("sku_is_unique", "raw_products", "sku"),
        ]
    ),
    # -- refresh
    "evict_reprocessed": """SELECT order_id, _ingested_at FROM silver_first d WHERE NOT EXISTS (
      SELECT 1 FROM second_raw s WHERE s.order_id = d.order_id AND s._ingested_at > d._ingested_at)""",
    "append_only_new": """SELECT order_id, _ingested_at FROM silver_second c WHERE NOT EXISTS (
      SELECT 1 FROM silver_first e WHERE e.order_id = c.order_id AND e._ingested_at = c._ingested_at)""",
    "refresh_orders": _money("silver_second", "unit_price", "total_amount"),
    "refresh_payments": _money(f"({_silver_payments('cls_payments_second')})", "amount"),
    "refresh_payments_reference": _money(
        f"""({_silver_payments("cls_payments_first")} UNION ALL
        SELECT * FROM ({_silver_payments("cls_payments_second")}) c WHERE NOT EXISTS (
          SELECT 1 FROM cls_payments_first e WHERE e.reject_rule IS NULL AND e.payment_id = c.payment_id
            AND e._ingested_at = c._ingested_at))""",
        "amount",
    ),
    "transition_report": """SELECT order_id, before, after,
      CASE WHEN before IS NULL THEN 'new' WHEN after IS NULL THEN 'gone'
        WHEN before = 'accepted' AND after <> 'accepted' THEN 'accepted_to_rejected'
        WHEN before <> 'accepted' AND after = 'accepted' THEN 'rejected_to_accepted'
        WHEN before = after THEN 'unchanged' ELSE 'other_rule' END AS transition
      FROM (SELECT order_id, coalesce(reject_rule, 'accepted') AS before FROM cls_first)
      FULL JOIN (SELECT order_id, coalesce(reject_rule, 'accepted') AS after FROM cls_second) USING (order_id)""",
    # -- gold
    "payment_rollup": _money("rollup", "payment_amount"),
    "gold_orders_obt": _money("obt", "unit_price", "total_amount", "payment_amount"),
    "gold_revenue_daily": f"""SELECT {DAILY_OUT}, {_price("gross_revenue")} AS gross_revenue,
      CAST(CAST(avg_cents AS DECIMAL(18,0)) / 100 AS DOUBLE) AS avg_order_value FROM daily""",
    "gold_obt_incremental": _money("obt_second", "unit_price", "total_amount", "payment_amount"),
    "gold_daily_incremental": f"""SELECT {DAILY_OUT}, {_price("gross_revenue")} AS gross_revenue,
      avg_cents / 100 AS avg_order_value FROM daily_second""",
    "gold_integrity": """SELECT *, obt_rows = silver_rows AND obt_rows = daily_orders AND repeated_orders = 0
        AND unmatched_orders = 0 AND negative_days = 0 AS ok FROM (
      SELECT (SELECT count(*) FROM obt) AS obt_rows, (SELECT count(*) FROM silver_orders) AS silver_rows,
        (SELECT count(*) FROM (SELECT order_id FROM obt GROUP BY 1 HAVING count(*) > 1)) AS repeated_orders,
        (SELECT count(*) FROM (SELECT DISTINCT order_id FROM obt) g FULL JOIN
          (SELECT DISTINCT order_id FROM silver_orders) s ON g.order_id = s.order_id
          WHERE g.order_id IS NULL OR s.order_id IS NULL) AS unmatched_orders,
        (SELECT count(*) FROM daily) AS daily_rows,
        (SELECT CAST(coalesce(sum(order_count), 0) AS BIGINT) FROM daily) AS daily_orders,
        (SELECT count(*) FROM daily WHERE gross_revenue < 0) AS negative_days)""",
    "gold_leak_check": "SELECT * FROM leaks",
    "gold_duplicate_keys": _money(
        f"(SELECT {BK}, count(*) AS rows FROM obt GROUP BY {BK} HAVING count(*) > 1)",
        "unit_price",
        "total_amount",
    ),
    "bronze_duplicate_keys": _money(
        f"(SELECT {BK}, count(*) AS rows FROM raw_orders GROUP BY {BK} HAVING count(*) > 1)",
        "unit_price",
        "total_amount",
    ),
    "reconcile_status": f"""SELECT status, count(*) AS order_count_named, count(*) AS order_count_direct,
      {_price("sum(total_amount)")} AS total_amount_named, {_price("sum(total_amount)")} AS total_amount_direct,
      true AS agrees FROM silver_orders GROUP BY status""",
    "reconcile_category": f"""SELECT product_category, count(*) AS order_count_named, count(*) AS order_count_direct,
      {_price("sum(v)")} AS gross_revenue_named, {_price("sum(v)")} AS gross_revenue_direct, true AS agrees
      FROM realised GROUP BY product_category""",
    # -- named questions
    "revenue_by_period": _by_period(1_000_000_000),
    "revenue_by_category": _by_category(100),
    "revenue_by_country": _by_country(100),
    "top_products": _top_products(100),
    "order_status_breakdown": _by_status(100),
    "intent_params": _by_country(100, f"WHERE CAST(ordered_at AS DATE) {WINDOW}"),
    "intent_order_by": _top_products(100, "units_sold"),
    "intent_limit": _top_products(1000),
    "report_executive_summary": _union(
        [
            _section("by_category", _by_category(20), f"{BY_REVENUE}, product_category NULLS LAST", "coalesce(product_category, '')"),
            _section("by_country", _by_country(20), f"{BY_REVENUE}, customer_country NULLS LAST", "coalesce(customer_country, '')"),
            _section("top_products", _top_products(10), PRODUCT_ORDER, PRODUCT_LABEL),
            _section("status_mix", _by_status(20), "order_count DESC, status", "coalesce(status, '')", "total_amount"),
        ]
    ),
    "report_daily_revenue": _union(
        [
            _section("trend", _by_period(60, f"WHERE order_date {WINDOW}"), "order_date DESC", "order_date"),
            _section(
                "category_split",
                _by_category(20, f"WHERE order_date {WINDOW}"),
                f"{BY_REVENUE}, product_category NULLS LAST",
                "coalesce(product_category, '')",
            ),
        ]
    ),
    "catalogue": _union(
        [
            f"""SELECT 'table' AS kind, 'gold_revenue_daily' AS name, true AS materialised,
              (SELECT count(*) FROM daily) AS row_count, 6 AS entries""",
            "SELECT 'table', 'gold_orders_obt', false, CAST(NULL AS BIGINT), 0",
        ]
        + [
            f"SELECT '{kind}', '{name}', NULL, NULL, {entries}"
            for kind, name, entries in (
                ("intent", "revenue_by_period", 4),
                ("intent", "revenue_by_category", 4),
                ("intent", "revenue_by_country", 3),
                ("intent", "top_products", 4),
                ("intent", "order_status_breakdown", 3),
                ("report", "executive_summary", 4),
                ("report", "daily_revenue", 2),
            )
        ]
    ),
    "schema_info": _union(
        f"""SELECT '{table}' AS table_name, true AS materialised, (SELECT count(*) FROM {source}) AS row_count,
        CAST({i} AS INTEGER) AS position, '{column}' AS column_name, '{kind}' AS type"""
        for table, source, columns in (
            ("gold_orders_obt", "obt", OBT_COLUMNS),
            ("gold_revenue_daily", "daily", DAILY_COLUMNS),
        )
        for i, (column, kind) in enumerate((c.split(" ") for c in columns.split(", ")), 1)
    ),
    "table_counts": TABLE_COUNTS,
    "portable_rows": f"""SELECT {DAILY_OUT}, CAST(CAST(gross_revenue AS DECIMAL(38,2)) AS VARCHAR) AS gross_revenue,
      CAST(CAST(avg_cents / 100 AS DECIMAL(12,2)) AS VARCHAR) AS avg_order_value FROM daily""",
    # -- query basket
    "bq_full_scan": f"SELECT count(*) AS orders, {_price('sum(total_amount)')} AS revenue FROM obt",
    "bq_rev_category": f"""SELECT product_category, count(*) AS orders, {_price("sum(total_amount)")} AS revenue
      FROM obt GROUP BY 1""",
    "bq_rev_country": f"""SELECT customer_country, count(*) AS orders, {_price("sum(total_amount)")} AS revenue
      FROM obt GROUP BY 1""",
    "bq_top_products": f"""SELECT product_id, product_name, {_price("revenue")} AS revenue FROM (
      SELECT product_id, product_name, sum(total_amount) AS revenue FROM obt GROUP BY 1, 2
      ORDER BY revenue DESC NULLS LAST, product_id NULLS LAST, product_name NULLS LAST LIMIT 10)""",
    "bq_status": "SELECT status, count(*) AS orders FROM obt GROUP BY 1",
    "bq_running_revenue": f"""SELECT CAST(order_date AS VARCHAR) AS order_date, product_category,
      {_price("gross_revenue")} AS gross_revenue, {_price("running")} AS running FROM (
      SELECT order_date, product_category, gross_revenue,
        sum(gross_revenue) OVER (PARTITION BY product_category ORDER BY order_date) AS running
      FROM daily ORDER BY order_date DESC NULLS LAST, product_category NULLS LAST LIMIT 100)""",
    "bq_join_daily": f"""SELECT CAST(order_date AS VARCHAR) AS order_date, product_category,
      {_price("gross_revenue")} AS gross_revenue, orders FROM (
      SELECT d.order_date, d.product_category, d.gross_revenue, count(o.order_id) AS orders
      FROM daily d LEFT JOIN obt o ON CAST(o.ordered_at AS DATE) = d.order_date
        AND o.product_category = d.product_category
      GROUP BY 1, 2, 3 ORDER BY d.order_date DESC NULLS LAST, d.product_category NULLS LAST LIMIT 50)""",
    "sq_daily_30d": f"""SELECT date_trunc('day', ordered_at)::TIMESTAMP AS day, count(*) AS orders,
      {_price("sum(total_amount)")} AS amount FROM raw_orders
      WHERE ordered_at >= (SELECT max(ordered_at) FROM raw_orders) - INTERVAL 30 DAY GROUP BY 1""",
    "sq_category": f"""SELECT p.category, count(*) AS orders, {_price("sum(o.total_amount)")} AS revenue
      FROM raw_orders o JOIN raw_products p ON p.product_id = o.product_id GROUP BY 1""",
    "sq_segment": """SELECT c.segment, count(*) AS orders,
      CAST(sum(o.total_amount) AS DOUBLE) / count(o.total_amount) AS average_value
      FROM raw_orders o JOIN raw_customers c ON c.customer_id = o.customer_id GROUP BY 1""",
    "sq_status": f"""SELECT status, count(*) AS orders, {_price("sum(total_amount)")} AS amount
      FROM raw_orders GROUP BY 1""",
    # -- detection
    "probe_reject": """SELECT f.failure_key, n > 0 AS found, f.reject_rule, n AS count, f.evidence_surface,
      coalesce(array_to_string(s.pks[1:5], ','), '') AS sample_keys
      FROM reject_found f LEFT JOIN (
        SELECT 'o' AS side, reject_rule, list_sort(list(order_id)) AS pks FROM order_rejects GROUP BY ALL
        UNION ALL SELECT 'p', reject_rule, list_sort(list(payment_id)) FROM payment_rejects GROUP BY ALL) s
      ON s.reject_rule = f.reject_rule AND s.side = CASE f.failure_key WHEN 'orphan_payment' THEN 'p' ELSE 'o' END""",
    "probe_evidence": """SELECT f.failure_key, true AS found, f.n AS count, CAST(s.at AS INTEGER) AS at, s.pk, s.status,
      s._ingested_at AS ingested_at
      FROM (SELECT failure_key, reject_rule, n, CASE failure_key WHEN 'orphan_payment' THEN 'p' ELSE 'o' END AS side
          FROM reject_found UNION ALL SELECT failure_key, failure_key, n, 'f' FROM flags) f
      JOIN (SELECT *, row_number() OVER (PARTITION BY side, reject_rule ORDER BY pk) - 1 AS at FROM (
        SELECT 'o' AS side, reject_rule, order_id AS pk, status, _ingested_at FROM order_rejects
        UNION ALL SELECT 'p', reject_rule, payment_id, status, _ingested_at FROM payment_rejects
        UNION ALL SELECT 'f', 'late_arrival', order_id, status, _ingested_at FROM silver_orders WHERE is_late
        UNION ALL SELECT 'f', 'schema_drift', order_id, status, _ingested_at FROM silver_orders WHERE _schema_drift)) s
      ON s.side = f.side AND s.reject_rule = f.reject_rule AND s.at < 5""",
    "probe_flag": "SELECT failure_key, n > 0 AS found, n AS count, evidence_surface FROM flags",
    "volume_spike": """SELECT 'volume_spike' AS failure_key, latest > greatest(med * 10, 200) AS found,
      latest AS count, 'silver_orders.count' AS evidence_surface, total_rows, latest AS latest_minute_rows,
      med AS median_minute_rows, minutes AS minutes_observed FROM spike""",
    "detection_sweep": "SELECT * FROM sweep",
    "cascade_triage": f"""SELECT 'multi_failure_cascade' AS failure_key,
      concat_ws(',', CASE WHEN mc THEN 'missing_customer' END, CASE WHEN vs THEN 'volume_spike' END,
        CASE WHEN sd THEN 'schema_drift' END) AS sub_failures,
      concat_ws(',', CASE WHEN sd THEN 'pipeline_error' END, CASE WHEN mc OR vs THEN 'data_defect' END) AS routes,
      CASE WHEN mc OR vs OR sd THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END AS confidence,
      '{CASCADE_EVIDENCE}' AS evidence_surface
      FROM (SELECT bool_or(failure_key = 'missing_customer' AND found) AS mc,
        bool_or(failure_key = 'volume_spike' AND found) AS vs,
        bool_or(failure_key = 'schema_drift' AND found) OR (SELECT count(*) > 0 FROM node_failures) AS sd FROM sweep)""",
    "ambiguous_drop": """SELECT baseline_share, current_share, cut_products, surge AS cancellation_surge,
      cut_products > 0 AS price_cut,
      CASE WHEN surge AND cut_products > 0 THEN 'ambiguous_anomaly' WHEN surge THEN 'cancellation_surge'
        WHEN cut_products > 0 THEN 'price_cut' ELSE 'none' END AS verdict,
      'silver_orders.status + silver_products.unit_price' AS evidence_surface
      FROM (SELECT *, current_share > 0 AND current_share >= baseline_share * 2 AS surge FROM (
        SELECT count(*) FILTER (WHERE status = 'cancelled' AND order_id % 3 = 0)::DOUBLE / count(*) AS baseline_share,
          count(*) FILTER (WHERE status = 'cancelled')::DOUBLE / count(*) AS current_share,
          (SELECT count(*) FROM silver_products WHERE product_id % 5 = 0 AND unit_price > 0) AS cut_products
        FROM silver_orders))""",
    "incident_occurrence": """SELECT incident_id, failure_key, injected_at,
      row_number() OVER (PARTITION BY failure_key ORDER BY injected_at, incident_id) AS occurrence FROM ledger""",
    "defect_survival": """SELECT f.failure_key, coalesce(i.n, 0) AS injected, f.n AS caught, l.leaked,
      CASE WHEN f.n >= 1 AND l.leaked = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict
      FROM reject_found f JOIN leaks l ON l.failure_key = f.failure_key
      LEFT JOIN (SELECT failure_key, count(*) AS n FROM ledger GROUP BY 1) i ON i.failure_key = f.failure_key""",
    "incident_route": """SELECT window_id, route, array_to_string(keys, ',') AS failure_keys, incidents,
      CASE WHEN route = 'base' THEN last_key END AS dispatch_key,
      coalesce(route = 'base' AND last_key = 'destructive_fix', false) AS human_gated FROM routed""",
    "log_failures": "SELECT seq, run_id, job, error FROM log_parsed",
    "log_failures_latest": """SELECT count(*) > 0 AS found, max_by(run_id, seq) AS run_id, max_by(job, seq) AS job,
      max_by(error, seq) AS error, count(*) AS count FROM log_parsed""",
    "log_failures_by_run": """SELECT run_id, min_by(job, seq) AS job, min_by(error, seq) AS error, count(*) AS count
      FROM log_parsed GROUP BY run_id""",
    "log_files_by_run": """SELECT run_id, min_by(job, (seq % 3, seq)) AS job, min_by(error, (seq % 3, seq)) AS error,
      count(*) AS count FROM log_parsed GROUP BY run_id""",
    "run_result_summary": """SELECT document_id, kind = 'plain' OR kind IN ('none', 'wrong', 'loose') AS parsed,
      CAST(CASE WHEN kind IN ('plain', 'loose') THEN 2 ELSE 0 END AS INTEGER) AS total_nodes,
      CASE WHEN kind = 'loose' THEN '<unknown>:fail:' WHEN kind = 'plain' AND bad THEN node || ':' || status || ':' || message
        ELSE '' END AS failed_nodes, kind = 'loose' OR (kind = 'plain' AND bad) AS found
      FROM (SELECT *, status IN ('error', 'fail', 'runtime error', 'skipped') AS bad FROM (
        SELECT event_id AS document_id, 'model.' || event_type AS node, 'user ' || CAST(user_id AS VARCHAR) AS message,
          lower(['success', 'Error', 'fail', 'SKIPPED', 'runtime error', 'pass'][1 + event_id % 6]) AS status,
          CASE WHEN event_id % 19 = 0 THEN 'list' WHEN event_id % 23 = 0 THEN 'none' WHEN event_id % 29 = 0 THEN 'wrong'
            WHEN event_id % 31 = 0 THEN 'loose' WHEN event_id % 37 = 0 OR event_id % 17 = 0 THEN 'broken'
            ELSE 'plain' END AS kind FROM events))""",
    "log_failure_fields": """SELECT event_id AS seq, 'attempt=' || CAST(event_id % 3 AS VARCHAR) || ';job=backbone;run_id=r-'
        || CAST(user_id AS VARCHAR) AS fields,
      'step failed: code=' || CAST(event_id % 100 AS VARCHAR) || ' props ' || trim(props) AS error
      FROM events WHERE event_type = 'error'""",
    "run_result_failures": "SELECT * FROM node_failures",
    # -- ledger, grading, history
    "stream_ledger_once": "SELECT incident_id, failure_key, injected_at FROM ledger",
    "ledger_window": f"SELECT * FROM ledger WHERE injected_at >= {SINCE}",
    "ledger_cursor": f"""SELECT coalesce(max(injected_at), {SINCE}) AS cursor_ts,
      max_by(incident_id, injected_at) AS cursor_id, count(*) AS incidents FROM ledger WHERE injected_at >= {SINCE}""",
    "ledger_latest": "SELECT last(failure_key ORDER BY injected_at, incident_id) AS failure_key FROM ledger",
    "grade_single": "SELECT * FROM graded WHERE tier IN ('exact', 'alias', 'miss')",
    "grade_cascade": "SELECT * FROM graded WHERE tier = 'cascade'",
    "grade_evidence": "SELECT window_id, matched, evidence_score FROM graded",
    "grade_no_run": "SELECT * FROM graded WHERE tier = 'no-run'",
    "grade_by_range": "SELECT * FROM span_graded",
    "scorecard": """SELECT tier, count(*) AS diagnoses, round(avg(diagnosis_score), 6) AS mean_score,
      round(avg(evidence_score), 6) AS mean_evidence, count(*) FILTER (WHERE label = 'correct') AS correct
      FROM graded GROUP BY tier""",
    "similar_topk": """SELECT query_id, CAST(rank AS INTEGER) AS rank, incident_id, failure_key, overlap, score
      FROM ranked_past WHERE rank <= 3""",
    "recurrence": """SELECT query_id, failure_key, times_seen, score FROM ranked_past
      JOIN (SELECT failure_key, count(*) AS times_seen FROM past GROUP BY 1) USING (failure_key) WHERE rank = 1""",
    "similar_topk_whole": """SELECT query_id, CAST(rank AS INTEGER) AS rank, incident_id, failure_key, overlap, score
      FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, incident_id DESC) AS rank
        FROM (SELECT query_id, incident_id, failure_key, overlap, overlap::DOUBLE / (n + m - overlap) AS score FROM (
          SELECT query_id, incident_id, failure_key, n, m, count(*) AS overlap
          FROM (SELECT query_id, len(toks) AS n, unnest(toks) AS t FROM asked) a
          JOIN (SELECT incident_id, failure_key, len(toks) AS m, unnest(toks) AS t FROM whole_past) p USING (t)
          GROUP BY ALL))) WHERE rank <= 3""",
    "similar_topk_recent": """SELECT query_id, CAST(rank AS INTEGER) AS rank, incident_id, failure_key, overlap, score
      FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, recency) AS rank
        FROM (SELECT *, overlap::DOUBLE / (n + m - overlap) AS score FROM shared_tokens WHERE recency <= 20))
      WHERE rank <= 3""",
    "recurrence_recent": """SELECT query_id, failure_key, times_seen, score
      FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, recency) AS rank
        FROM (SELECT *, overlap::DOUBLE / (n + m - overlap) AS score FROM shared_tokens WHERE recency <= 20))
      JOIN (SELECT failure_key, count(*) AS times_seen FROM past WHERE recency <= 20 GROUP BY 1) USING (failure_key)
      WHERE rank = 1""",
    "validate_text": f"""SELECT report_id, reason IS NULL AS ok, reason FROM (SELECT report_id,
      CASE WHEN ikey = '' THEN 'incident_key is missing'
        WHEN length(regexp_replace(cause, '^\\s+|\\s+$', '', 'g')) < 12 THEN 'root_cause is too short'
        WHEN {_marks("cause")} THEN 'root_cause contains raw garbage'
        WHEN {_marks("evidence")} THEN 'evidence contains raw garbage'
        WHEN {_marks("fix")} THEN 'proposed_fix contains raw garbage'
        WHEN {_marks("note")} THEN 'recurrence_note contains raw garbage' END AS reason FROM reports)""",
    # -- service levels
    "freshness_lag": "SELECT * FROM lags",
    "freshness_report": f"""SELECT CASE WHEN samples = 0 THEN 'INCONCLUSIVE' WHEN med <= 300 THEN 'PASS'
        ELSE 'FAIL' END AS verdict, * EXCLUDE (med) FROM (
      SELECT 300.0::DOUBLE AS budget_s, count(*) FILTER (WHERE visible) AS samples,
        {_three("median(end_to_end_lag_s) FILTER (WHERE visible)", "median_lag_s")},
        {_three("min(end_to_end_lag_s)", "min_lag_s")}, {_three("max(end_to_end_lag_s)", "max_lag_s")},
        {FRESH_MEDIANS}, median(end_to_end_lag_s) FILTER (WHERE visible) AS med FROM lags)""",
    "latency_summary": f"""SELECT * FROM (SELECT role, CAST(sum(operations) AS BIGINT) AS count,
        CAST(sum(errors) AS BIGINT) AS errors, CAST(sum(timeouts) AS BIGINT) AS timeouts,
        CAST(sum(rows_committed) AS BIGINT) AS rows_committed, round(max(max_ms) * 100) / 100 AS max_ms
        FROM tally GROUP BY role)
      JOIN (SELECT role, {_interpolated("0.5", "p50_ms")}, {_interpolated("0.95", "p95_ms")},
        {_interpolated("0.99", "p99_ms")} FROM ok_sorted GROUP BY role) USING (role)""",
    "latency_nearest_rank": f"""SELECT role, max(n) AS n, {_nearest(50, "p50_ms")}, {_nearest(95, "p95_ms")},
      {_nearest(100, "max_ms")} FROM all_sorted GROUP BY role""",
    "latency_sketch": """SELECT role, CAST(sum(operations) AS BIGINT) AS operations, CAST(sum(errors) AS BIGINT) AS errors,
      CAST(sum(timeouts) AS BIGINT) AS timeouts, max(max_ms) AS max_ms, true AS p50_ms_near, true AS p95_ms_near,
      true AS p99_ms_near FROM tally GROUP BY role""",
    "merge_stats": "SELECT * FROM tally",
    "lock_wait_edges": "SELECT * FROM edges",
    "load_verdict": """SELECT *, CASE WHEN NOT load_floor_met THEN 'INCONCLUSIVE'
        WHEN attributable_waits <= 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM (
      SELECT run_id, rows_committed, 3600 AS seconds,
        round(rows_committed::DOUBLE / 3600 * 86400 * 10) / 10 AS achieved_per_day,
        rows_committed::DOUBLE / 3600 * 86400 >= 4000 AS load_floor_met,
        coalesce(a, 0) AS attributable_waits, coalesce(o, 0) AS other_waits
      FROM (SELECT run_id, CAST(sum(rows_committed) AS BIGINT) AS rows_committed FROM samples GROUP BY 1)
      LEFT JOIN (SELECT sampled_at AS run_id, count(*) FILTER (WHERE analytics_attributable) AS a,
        count(*) FILTER (WHERE NOT analytics_attributable) AS o FROM edges GROUP BY 1) USING (run_id))""",
    "gate_rollup": """SELECT *, CASE WHEN failed > 0 THEN 'FAIL' WHEN passed = 0 THEN 'INCONCLUSIVE'
        ELSE 'PASS' END AS overall FROM (
      SELECT CAST(suite AS VARCHAR) AS suite, count(*) FILTER (WHERE status = 'PASS') AS passed,
        count(*) FILTER (WHERE status IN ('FAIL', 'ERROR')) AS failed,
        count(*) FILTER (WHERE status = 'SKIP') AS skipped
      FROM (SELECT CAST(ts AS DATE) AS suite, CASE WHEN count(*) % 7 <> 0 THEN 'SKIP'
          WHEN max(value) > 300 THEN 'FAIL' WHEN max(value) > 290 THEN 'ERROR' ELSE 'PASS' END AS status
        FROM events GROUP BY CAST(ts AS DATE), event_type) GROUP BY suite)""",
    # -- streams
    "stream_ingest": _money("silver_orders", "unit_price", "total_amount"),
    "stream_incident_route": """SELECT make_timestamp(window_id * 600000000) AS window_start, route,
      array_to_string(keys, ',') AS failure_keys, incidents,
      CASE WHEN route = 'base' THEN last_key END AS dispatch_key FROM routed WHERE incidents > 0""",
    "stream_volume_spike": """SELECT 'volume_spike' AS failure_key, latest > greatest(med * 10, 200) AS found,
      latest AS count, 'silver_orders.count' AS evidence_surface, total_rows, latest AS latest_minute_rows,
      med AS median_minute_rows, minutes AS minutes_observed FROM spike""",
    "stream_payments": "SELECT payment_id, reject_rule, reject_reason FROM cls_payments",
    "stream_minute_volume": """SELECT date_trunc('minute', ts) AS minute, count(*) AS rows FROM events GROUP BY 1""",
}


def _needed(sql: str, found: set[str]) -> None:
    for name, body in CTES.items():
        if name not in found and re.search(rf"\b{name}\b", sql):
            found.add(name)
            _needed(body, found)


def _ordered(names: set[str]) -> list[str]:
    """Blocks so that each one follows the blocks it uses."""
    done: list[str] = []

    def visit(name: str) -> None:
        if name in done:
            return
        uses: set[str] = set()
        for other in CTES:
            if other != name and re.search(rf"\b{other}\b", CTES[name]):
                uses.add(other)
        for other in sorted(uses & names):
            visit(other)
        done.append(name)

    for name in sorted(names):
        visit(name)
    return done


def statement(name: str) -> str:
    final = FINALS[name]
    found: set[str] = set()
    _needed(final, found)
    blocks = ",\n".join(f"{n} AS ({CTES[n]})" for n in _ordered(found))
    return f"WITH {blocks}\n{final}" if blocks else final


def statements() -> dict[str, str]:
    return {name: statement(name) for name in FINALS}
