"""SQL of the adapters, as WITH clauses that the queries' SQL begins with."""

from __future__ import annotations

SERIES = """
raw_series AS (SELECT vec_id AS clip_id, unnest(generate_series(0, len(embedding) - 1)) AS i, embedding::DOUBLE[] AS e FROM embeddings),
series AS (SELECT clip_id, i, i * 0.1::DOUBLE AS t, abs(e[i + 1]) * 40 AS speed, e[i + 1] * 10 AS accel, e[(i + 7) % len(e) + 1] * 0.5::DOUBLE AS yaw_rate, e[(i + 13) % len(e) + 1] * 20 AS jerk FROM raw_series)"""

TRACK = """
track AS (SELECT user_id AS clip_id, row_number() OVER w - 1 AS k, (epoch_us(ts) - first_value(epoch_us(ts)) OVER w) / 1e6::DOUBLE AS ts,
  value AS x, value * value / 100 AS y, (event_id % 7)::DOUBLE - 3.0::DOUBLE AS yaw FROM events WINDOW w AS (PARTITION BY user_id ORDER BY events.ts, event_id))"""

CLASSES = """
classes AS (SELECT 'm' || l_linenumber AS model, l_orderkey AS clip_id, o_orderpriority AS category, l_returnflag AS question_id,
  CASE WHEN l_suppkey % 3 = 0 THEN 'real' ELSE 'simulated' END AS source, o_orderstatus AS oracle, l_linestatus AS pred FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

ANSWERS = """
first_order AS (SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) AS s, arg_min(o_orderpriority, o_orderkey) AS p, arg_min(o_totalprice, o_orderkey) AS v FROM orders GROUP BY o_custkey),
answers AS (SELECT o_custkey AS clip_id, CASE WHEN o_custkey % 2 = 0 THEN 'real' ELSE 'simulated' END AS source, q.question_id,
  CASE q.question_id WHEN 'status' THEN s WHEN 'priority' THEN p ELSE CASE WHEN v < 150000 THEN 'low' WHEN v < 300000 THEN 'medium' ELSE 'high' END END AS answer
  FROM first_order CROSS JOIN (VALUES ('status'), ('priority'), ('price')) q(question_id))"""

REPLIES = "replies AS (SELECT conv_id, turn, text AS model_answer FROM conversations WHERE role = 'assistant')"

FEATURES = (
    SERIES
    + """,
ordered AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY abs(yaw_rate) DESC, i) AS peak_rank FROM series),
features AS (SELECT clip_id, max(speed) AS max_speed, avg(speed) AS mean_speed, min(accel) AS min_accel, max(accel) AS max_accel, avg(accel) AS mean_accel,
  max(abs(yaw_rate)) AS max_abs_yaw_rate, max(CASE WHEN peak_rank = 1 THEN yaw_rate END) AS signed_max_yaw_rate, max(abs(jerk)) AS max_abs_jerk,
  quantile_cont(abs(jerk), 0.95) AS p95_abs_jerk, avg(abs(jerk)) AS mean_abs_jerk, max(speed * abs(yaw_rate)) AS max_lateral_accel, sum(CASE WHEN i > 0 THEN abs(yaw_rate) * 0.1 ELSE 0 END) AS total_heading_change
  FROM ordered GROUP BY clip_id)"""
)


def sql(*clauses: str, select: str) -> str:
    """A query that begins with the given WITH clauses; a select that begins with a comma goes on with clauses of its own."""
    head = "WITH " + ",\n".join(c.strip() for c in clauses)
    return head + ("" if select.lstrip().startswith(",") else "\n") + select.strip()
