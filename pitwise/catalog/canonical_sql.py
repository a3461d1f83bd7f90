"""DuckDB twins of `pitwise.sources.adapters` as named CTEs.

`with_ctes(body, *names)` prefixes a query with the CTEs it needs (and
their dependencies) in definition order.
"""

from __future__ import annotations

import re

CTES: dict[str, str] = {}

CTES["visits_nation"] = """
SELECT c.c_nationkey AS store_id, CAST(o.o_orderdate AS DATE) AS visit_date,
       count(*) AS visitors, sum(o.o_totalprice) AS sales
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
GROUP BY 1, 2"""

CTES["visits_customer"] = """
SELECT o_custkey AS store_id, CAST(o_orderdate AS DATE) AS visit_date,
       count(*) AS visitors, sum(o_totalprice) AS sales
FROM orders GROUP BY 1, 2"""

CTES["visits_user"] = """
SELECT user_id AS store_id, CAST(ts AS DATE) AS visit_date, count(*) AS visitors,
       sum(value) AS value_sum
FROM events GROUP BY 1, 2"""

CTES["stores"] = """
SELECT n.n_nationkey AS store_id, g.air_genre_name,
       r.r_name || ' ' || n.n_name AS air_area_name,
       CAST(r.r_regionkey AS DOUBLE) AS latitude, CAST(n.n_nationkey AS DOUBLE) AS longitude
FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey
LEFT JOIN (
  SELECT c_nationkey, c_mktsegment AS air_genre_name FROM (
    SELECT c_nationkey, c_mktsegment,
           row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, c_mktsegment) AS rn
    FROM customer GROUP BY 1, 2) WHERE rn = 1
) g ON n.n_nationkey = g.c_nationkey"""

CTES["customers_as_stores"] = """
SELECT c_custkey AS store_id, c_mktsegment AS genre, c_nationkey AS area FROM customer"""

CTES["date_info"] = """
SELECT visit_date, dayname(visit_date) AS day_of_week,
       CAST(day(visit_date) IN (1, 2, 15) AS INTEGER) AS holiday_flg,
       CAST(isodow(visit_date) - 1 > 4 OR day(visit_date) IN (1, 2, 15) AS INTEGER) AS holiday_flg2
FROM (SELECT CAST(unnest(generate_series(min(visit_date), max(visit_date), INTERVAL 1 DAY)) AS DATE)
             AS visit_date FROM visits_nation)"""

CTES["reservations"] = """
SELECT c.c_nationkey AS store_id, o.o_orderdate AS reserve_datetime, l.l_shipdate AS visit_datetime,
       CAST(l.l_quantity AS INTEGER) AS reserve_visitors,
       CASE WHEN l.l_returnflag = 'A' THEN 'air' ELSE 'hpg' END AS system
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
WHERE l.l_shipdate >= o.o_orderdate"""

CTES["id_relation"] = """
SELECT c_custkey AS hpg_store_id, c_nationkey AS air_store_id FROM customer WHERE c_custkey % 2 = 0"""

CTES["submission"] = """
SELECT CAST(s.store_id AS VARCHAR) || '_' || strftime(d.visit_date, '%Y-%m-%d') AS id, 0 AS visitors
FROM stores s CROSS JOIN (
  SELECT CAST(unnest(generate_series(max(visit_date) + 1, max(visit_date) + 39, INTERVAL 1 DAY)) AS DATE)
         AS visit_date FROM visits_nation) d"""

CTES["weather"] = """
SELECT visit_date, store_id,
  CASE WHEN dn % 7 = 3 THEN NULL ELSE CAST(dn % 30 AS DOUBLE) + store_id * 0.5 END AS avg_temperature,
  CASE WHEN dn % 7 = 3 THEN NULL ELSE CAST((dn + store_id) % 12 AS DOUBLE) END AS hours_sunlight,
  CAST(dn % 17 AS DOUBLE) * 1.5 AS solar_radiation,
  CASE WHEN dn % 7 = 3 THEN NULL ELSE CAST((dn % 5) * store_id AS DOUBLE) END AS total_snowfall,
  CAST((dn * 7 + store_id) % 100 AS DOUBLE) AS avg_humidity
FROM (SELECT d.visit_date, s.store_id, CAST(d.visit_date - DATE '1970-01-01' AS INTEGER) AS dn
      FROM date_info d CROSS JOIN stores s)"""

CTES["clinical"] = """
SELECT o_orderkey AS _id, o_orderpriority AS BE_PRIORITY, o_orderstatus AS BE_STATUS,
       o_custkey AS BE_CUSTKEY, (o_custkey % 7 = 0) AS BE_FLAG,
       CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_totalprice END AS TRANS_RBC,
       o_totalprice / 1000.0 AS AF_PRICE_K, epoch_ms(o_orderdate) AS dt_data,
       'CONST' AS DEPT_CODE, CAST(NULL AS DOUBLE) AS RBC_LOSS,
       CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 13 END AS OP_CODE
FROM orders"""

CTES["texts"] = """
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""

CTES["ratings"] = """
SELECT o.o_custkey AS "user", l.l_partkey % 200 AS item, avg(l.l_quantity) AS rating
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey GROUP BY 1, 2"""

CTES["class_probs"] = """
SELECT user_id,
  [n0 / n, n1 / n, n2 / n, n3 / n, n4 / n] AS p,
  CASE greatest(n0, n1, n2, n3, n4) WHEN n0 THEN 0 WHEN n1 THEN 1 WHEN n2 THEN 2 WHEN n3 THEN 3 ELSE 4 END
    AS actual
FROM (SELECT user_id,
        count(*) FILTER (WHERE event_type = 'click') AS n0,
        count(*) FILTER (WHERE event_type = 'error') AS n1,
        count(*) FILTER (WHERE event_type = 'purchase') AS n2,
        count(*) FILTER (WHERE event_type = 'signup') AS n3,
        count(*) FILTER (WHERE event_type = 'view') AS n4,
        count(*) AS n
      FROM events GROUP BY user_id)"""

CTES["regressions"] = """
SELECT CAST(store_id AS VARCHAR) || '_' || strftime(visit_date, '%Y-%m-%d') AS id, store_id, visit_date,
       ln(1 + visitors) AS actual,
       avg(ln(1 + visitors)) OVER (PARTITION BY store_id, isodow(visit_date)) AS pred_a,
       avg(ln(1 + visitors)) OVER (PARTITION BY store_id) AS pred_b
FROM visits_nation"""

_ORDER = list(CTES)


def _deps(name: str) -> list[str]:
    body = CTES[name]
    return [n for n in _ORDER if n != name and re.search(rf"\b{n}\b", body)]


def with_ctes(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """Prefix `body` with the named canonical CTEs (dependencies first), then `extra` ones."""
    need: list[str] = []

    def add(n: str) -> None:
        for d in _deps(n):
            add(d)
        if n not in need:
            need.append(n)

    for n in names:
        add(n)
    parts = [f"{n} AS ({CTES[n]}\n)" for n in need]
    for k, v in (extra or {}).items():
        parts.append(f"{k} AS ({v}\n)")
    if not parts:
        return body
    return "WITH " + ",\n".join(parts) + "\n" + body
