"""Queries of states that follow from events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiltwork.plans.catalogue import query
from quiltwork.plans.views import table
from quiltwork.streaming import freshness as fresh

_KIND = "CASE event_type WHEN 'click' THEN 'change' WHEN 'view' THEN 'update' WHEN 'purchase' THEN 'updated' WHEN 'error' THEN 'publish' ELSE 'published' END"
_RANK = "list_position(['published', 'updated', 'change', 'publish', 'update', 'quiet'], k)"


@query(f"""WITH e AS (SELECT user_id, ts AS t, {_KIND} AS k FROM events), n AS (SELECT *, {_RANK} AS r FROM e),
    c AS (SELECT user_id, t, min(CASE WHEN k IN ('change', 'update') THEN t END) OVER (PARTITION BY user_id ORDER BY t, r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt, k FROM n),
    timers AS (SELECT user_id, t + INTERVAL 2 HOUR AS t, 'quiet' AS k FROM c WHERE k = 'change' AND (nxt IS NULL OR nxt > t + INTERVAL 2 HOUR)),
    marked AS (SELECT *, {_RANK} AS r FROM (SELECT user_id, t, k FROM e UNION ALL SELECT * FROM timers)),
    grouped AS (SELECT *, max(CASE WHEN k IN ('publish', 'published') THEN row_number END) OVER w AS p, max(CASE WHEN k IN ('update', 'quiet', 'updated') THEN row_number END) OVER w AS u, max(CASE WHEN k IN ('change', 'update', 'quiet') THEN row_number END) OVER w AS s
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, r) AS row_number FROM marked) WINDOW w AS (PARTITION BY user_id ORDER BY row_number)),
    states AS (SELECT g.user_id, g.t, g.row_number, CASE WHEN a.k = 'publish' THEN 'Publishing' WHEN b.k IN ('update', 'quiet') THEN 'Updating' WHEN c.k = 'change' THEN 'Stale' ELSE 'Ok' END AS state
        FROM grouped g LEFT JOIN grouped a ON a.user_id = g.user_id AND a.row_number = g.p LEFT JOIN grouped b ON b.user_id = g.user_id AND b.row_number = g.u LEFT JOIN grouped c ON c.user_id = g.user_id AND c.row_number = g.s)
    SELECT user_id, t AS ts, before, state AS after FROM (SELECT *, coalesce(lag(state) OVER (PARTITION BY user_id ORDER BY row_number), 'Ok') AS before FROM states) WHERE before <> state""")
def freshness_states(spark: SparkSession, d: str) -> DataFrame:
    """Each user's state, from events and from two quiet hours after changes."""
    kinds = {"click": "change", "view": "update", "purchase": "updated", "error": "publish"}
    kind = F.lit("published")
    for name, to in kinds.items():
        kind = F.when(F.col("event_type") == name, to).otherwise(kind)
    rows = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"))
    return fresh.freshness(rows, "user_id", "ts", "kind", 7_200_000)
