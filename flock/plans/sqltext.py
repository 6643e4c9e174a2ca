"""DuckDB text of the fixture adapter and of the calendar expressions.

This is the *oracle* side of the correctness check: the same domain views as
``flock.sources.fixtures``, written as SQL over the driver's pre-registered
views, plus expression templates equal to ``flock.functions.dates``.
"""

from __future__ import annotations

AS_OF = "2001-08-01"
SINCE_YEAR = 1998

ADAPTER = {
    "person": """
  SELECT c_custkey AS id,
         CAST(DATE '1995-01-01' + CAST(c_custkey * 7 % 2400 AS INTEGER) AS TIMESTAMP) AS created_ts,
         CASE WHEN c_custkey % 5 = 0 THEN c_custkey END AS foreign_id,
         CAST(1 AS INTEGER) AS record_type_id,
         CAST(NULLIF(c_nationkey % 3, 0) AS INTEGER) AS gender,
         CAST(1930 + c_custkey % 80 AS INTEGER) AS birth_year,
         CAST(CASE c_mktsegment WHEN 'BUILDING' THEN 143 WHEN 'HOUSEHOLD' THEN 144
              WHEN 'MACHINERY' THEN 1792 WHEN 'FURNITURE' THEN 1886 END AS INTEGER) AS marital_status_id,
         CAST(c_custkey % 3 AS INTEGER) AS age_classification,
         1000000 + c_custkey % (50 + c_custkey % 400) AS primary_family_id
  FROM customer""",
    "person_alias": """
  SELECT c_custkey AS id,
         CASE WHEN c_custkey % 10 = 9 THEN c_custkey - 1 ELSE c_custkey END AS person_id,
         c_custkey AS alias_person_id
  FROM customer""",
    "attendance": """
  SELECT o_orderkey AS id, o_custkey AS person_alias_id, o_orderkey AS occurrence_id,
         o_orderdate AS start_ts, CAST(o_orderstatus <> 'P' AS INTEGER) AS did_attend
  FROM orders""",
    "attendance_occurrence": """
  SELECT o_orderkey AS id,
         CAST(CASE WHEN o_orderpriority = '5-LOW' THEN 3000030 ELSE 3000001 END AS BIGINT) AS group_id
  FROM orders""",
    "grp": """
  SELECT s_suppkey AS id, s_suppkey AS group_type_id, CAST(NULL AS INTEGER) AS campus_id FROM supplier
  UNION ALL
  SELECT DISTINCT 1000000 + c_custkey % (50 + c_custkey % 400), CAST(NULL AS BIGINT), CAST(NULL AS INTEGER)
  FROM customer
  UNION ALL
  SELECT * FROM (VALUES (CAST(3000001 AS BIGINT), CAST(NULL AS BIGINT), 1),
                        (CAST(3000030 AS BIGINT), CAST(NULL AS BIGINT), 30)) v(id, group_type_id, campus_id)""",
    "group_type": """
  SELECT s.s_suppkey AS id,
         CAST(CASE WHEN r.r_name = 'EUROPE' AND s.s_suppkey % 7 = 0 THEN 184
                   WHEN r.r_name = 'ASIA' THEN 157176 END AS INTEGER) AS purpose_value_id
  FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey
       JOIN region r ON r.r_regionkey = n.n_regionkey""",
    "group_member": """
  SELECT DISTINCT l.l_suppkey AS group_id, o.o_custkey AS person_id
  FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey
  UNION ALL
  SELECT 1000000 + c_custkey % (50 + c_custkey % 400) AS group_id, c_custkey AS person_id FROM customer""",
    "gift": """
  SELECT l.l_orderkey * 10 + l.l_linenumber AS id, o.o_custkey AS person_alias_id, l.l_shipdate AS created_ts
  FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey
  WHERE l.l_returnflag = 'R'""",
    "connection_request": """
  SELECT event_id AS id, user_id AS person_alias_id,
         CAST(CASE event_type WHEN 'signup' THEN 13 WHEN 'purchase' THEN 26 WHEN 'click' THEN 11
              WHEN 'view' THEN 7 WHEN 'error' THEN 24 END AS INTEGER) AS opportunity_id
  FROM events""",
    "connection_opportunity": """
  SELECT CAST(id AS INTEGER) AS id FROM (VALUES (4), (7), (11), (13), (24), (25), (26)) v(id)""",
    "daily_attendance": """
  SELECT user_id AS person_alias_id, ts AS start_ts, CAST(event_type = 'view' AS INTEGER) AS is_online
  FROM events WHERE event_type <> 'error'""",
}


def with_adapter(*ctes: str, select: str) -> str:
    """``WITH <adapter views>, <ctes> <select>``; each cte is ``name AS (...)``."""
    parts = [f"{name} AS ({body}\n)" for name, body in ADAPTER.items()]
    parts.extend(c.strip() for c in ctes)
    return "WITH " + ",\n".join(parts) + "\n" + select.strip()


# Calendar expression templates (DuckDB), equal to flock.functions.dates.
def month_bucket(t: str) -> str:
    return f"CAST(date_trunc('month', {t}) AS DATE)"


def week_label(t: str) -> str:
    return f"(CAST({t} AS DATE) - CAST(dayofweek({t}) + 1 AS INTEGER))"


def week_start_sat(t: str) -> str:
    return f"(CAST({t} AS DATE) - CAST((dayofweek({t}) + 1) % 7 AS INTEGER))"


def sunday_week(d: str) -> str:
    return f"CAST(floor((CAST({d} AS DATE) - DATE '1970-01-01' + 4) / 7.0) AS BIGINT)"


def month_diff(a: str, b: str) -> str:
    return f"CAST((year({b}) - year({a})) * 12 + month({b}) - month({a}) AS INTEGER)"


def day_diff(a: str, b: str) -> str:
    return f"CAST(CAST({b} AS DATE) - CAST({a} AS DATE) AS INTEGER)"


def pct(flag: str) -> str:
    return (f"CAST(CAST(sum({flag}) / CAST(count(*) AS DECIMAL(19, 2)) * 100 AS DECIMAL(19, 2)) AS DOUBLE)")


def closed_threshold(as_of: str = AS_OF) -> str:
    return f"(CAST(DATE '{as_of}' - INTERVAL 2 MONTH AS DATE) - DATE '1900-01-01')"
