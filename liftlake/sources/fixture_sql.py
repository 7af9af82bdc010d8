"""DuckDB twins of the adapter views in ``fixtures`` (oracle side).

``with_views(sql, *names)`` prefixes an oracle query with the CTEs it needs.
The expressions mirror ``fixtures`` one for one.
"""

from __future__ import annotations

_BODY_PART_CASE = ("CASE {c} WHEN 'STANDARD' THEN 'chest' WHEN 'PROMO' THEN 'back' "
                   "WHEN 'SMALL' THEN 'shoulder' WHEN 'LARGE' THEN 'leg' "
                   "WHEN 'ECONOMY' THEN 'arm' WHEN 'MEDIUM' THEN 'other' END")

VIEWS: dict[str, str] = {}

VIEWS["training_log"] = f"""
SELECT
  CAST(l.l_orderkey AS VARCHAR) || '-' || CAST(l.l_linenumber AS VARCHAR) AS log_id,
  'user_' || CAST(l.l_suppkey AS VARCHAR) AS user_id,
  CASE WHEN p.p_partkey % 2 = 1 THEN '　' || upper(p.p_name) || ' ' ELSE p.p_name END AS exercise_name,
  CASE WHEN p.p_partkey % 5 = 0 THEN upper({_BODY_PART_CASE.format(c='p.p_type')})
       ELSE {_BODY_PART_CASE.format(c='p.p_type')} END AS body_part,
  CAST(l.l_shipdate AS DATE) AS training_date,
  CAST(l.l_linenumber AS BIGINT) AS set_number,
  l.l_quantity * 2.5 AS weight_kg,
  1 + CAST(round(l.l_discount * 100) AS BIGINT) AS reps,
  5.5 + 0.5 * round(l.l_tax * 100) AS rpe,
  CAST(NULL AS VARCHAR) AS memo,
  'streamlit' AS input_source,
  o.o_orderdate AS created_at,
  l.l_shipdate AS updated_at,
  (l.l_returnflag = 'R' AND l.l_linestatus = 'O') AS is_deleted,
  l.l_suppkey,
  l.l_partkey
FROM lineitem l
JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN part p ON l.l_partkey = p.p_partkey
"""

VIEWS["exercise_master"] = f"""
SELECT
  replace(p_name, ' ', '_') AS exercise_id,
  p_name AS exercise_name,
  {_BODY_PART_CASE.format(c='arg_min(p_type, p_partkey)')} AS body_part_id,
  min(p_partkey) % 4 = 0 AS is_compound,
  min(p_partkey) % 16 <> 15 AS is_active,
  CAST(1 + min(p_partkey) % 100 AS BIGINT) AS display_order,
  TIMESTAMP '2001-01-01 00:00:00' AS updated_at
FROM part
GROUP BY p_name
"""

VIEWS["user_master"] = """
SELECT
  'user_' || CAST(s_suppkey AS VARCHAR) AS user_id,
  s_name AS user_name,
  'U_' || CAST(s_suppkey AS VARCHAR) AS line_user_id,
  s_suppkey = 1 AS is_admin,
  s_suppkey % 20 <> 19 AS is_active,
  TIMESTAMP '2001-01-01 00:00:00' AS created_at
FROM supplier
"""

VIEWS["exercise_request"] = """
SELECT
  'req_' || CAST(c_custkey AS VARCHAR) AS request_id,
  'user_' || CAST(1 + c_custkey % 10 AS VARCHAR) AS user_id,
  lower(c_mktsegment) || ' ' || CAST(c_nationkey % 5 AS VARCHAR) AS exercise_name,
  CASE c_nationkey % 6 WHEN 0 THEN 'chest' WHEN 1 THEN 'back' WHEN 2 THEN 'shoulder'
       WHEN 3 THEN 'leg' WHEN 4 THEN 'arm' WHEN 5 THEN 'other' END AS body_part_id,
  c_name AS reason,
  CASE c_custkey % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'approved' ELSE 'rejected' END AS status,
  CASE WHEN c_custkey % 3 <> 0 THEN 'user_1' END AS reviewed_by,
  TIMESTAMP '2001-01-01 00:00:00' + to_hours(CAST(c_custkey % 8760 AS INTEGER)) AS created_at,
  CASE WHEN c_custkey % 3 <> 0 THEN TIMESTAMP '2001-01-01 00:00:00'
       + to_hours(CAST(c_custkey % 8760 AS INTEGER)) + INTERVAL 1 DAY END AS reviewed_at
FROM customer
"""

VIEWS["notification_log"] = """
SELECT
  CAST(event_id AS VARCHAR) AS notification_id,
  'user_' || CAST(user_id AS VARCHAR) AS user_id,
  CASE event_type WHEN 'view' THEN 'start' WHEN 'click' THEN '3day' WHEN 'signup' THEN '7day'
       WHEN 'error' THEN 'weekly_ranking' WHEN 'purchase' THEN 'monthly_ranking' END AS notification_type,
  CASE event_id % 10 WHEN 8 THEN 'failed' WHEN 9 THEN 'suppressed' ELSE 'sent' END AS status,
  CAST(ts AS TIMESTAMP) AS sent_at
FROM events
"""

VIEWS["documents_flat"] = """
SELECT
  user_id || '_' || CAST(training_date AS VARCHAR) || '_' || exercise_id AS doc_id,
  user_id, training_date, exercise_id, body_part_id, key_num,
  CASE WHEN key_num % 3 = 0 THEN NULL ELSE 'streamlit' END AS input_source,
  key_num % 17 = 0 AS doc_is_deleted,
  CASE WHEN key_num % 2 = 0 THEN 'pending' ELSE 'synced' END AS sync_status,
  log_id, set_number, weight_kg, reps, rpe, memo, is_deleted,
  strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS created_at,
  strftime(updated_at, '%Y-%m-%dT%H:%M:%S') AS updated_at
FROM (
  SELECT t.*,
    replace(lower(trim(exercise_name)), ' ', '_') AS exercise_id,
    lower(body_part) AS body_part_id_raw,
    min(lower(body_part)) OVER (PARTITION BY user_id, training_date, replace(lower(trim(exercise_name)), ' ', '_')) AS body_part_id,
    min(date_diff('day', DATE '1995-01-01', training_date) + l_suppkey)
      OVER (PARTITION BY user_id, training_date, replace(lower(trim(exercise_name)), ' ', '_')) AS key_num
  FROM training_log t
) x
"""

_DEPENDS = {"documents_flat": ["training_log"]}


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with CTEs for the named adapter views (dependencies first)."""
    order: list[str] = []

    def add(n):
        for d in _DEPENDS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in order)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
