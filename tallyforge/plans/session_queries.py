"""Registered query over conversation sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.plans.catalog import query
from tallyforge.session import table
from tallyforge.streaming import sessions

TTL, MOST = 7200, 6


@query(
    "session_store",
    f"""WITH e AS (SELECT event_id, user_id, user_id % 2 AS store, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id % 2 ORDER BY ts, event_id) AS i FROM events),
    l AS (SELECT *, lag(i) OVER (PARTITION BY user_id ORDER BY i) AS last_i, lag(t) OVER (PARTITION BY user_id ORDER BY i) AS last_t FROM e),
    d AS (SELECT l.event_id, count(DISTINCT o.user_id) AS recent, count(DISTINCT o.user_id) FILTER (o.i > l.last_i AND o.user_id <> l.user_id) AS between_
          FROM l LEFT JOIN e o ON o.store = l.store AND o.i < l.i AND l.t - o.t < {TTL}000000 GROUP BY l.event_id),
    s AS (SELECT l.*, recent, coalesce(l.t - last_t < {TTL}000000, false) AND between_ < {MOST} AS open FROM l JOIN d USING (event_id)),
    r AS (SELECT *, sum(CASE WHEN open THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY i) AS run FROM s)
    SELECT event_id AS command_id, CAST(user_id AS VARCHAR) AS session_id, CASE WHEN open THEN 'appended' ELSE 'created' END AS outcome, NOT open AND recent >= {MOST} AS evicts,
           row_number() OVER (PARTITION BY user_id, run ORDER BY i) - 1 AS turn_index, least(8, row_number() OVER (PARTITION BY user_id, run ORDER BY i)) AS turns_kept FROM r""",
)
def session_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a turn of its user, in two stores of six sessions that live two hours.

    The SQL says the same without a walk: a session is open if fewer than six others were touched since its last turn.
    """
    rows = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 2).cast("string").alias("store"), F.col("event_id").alias("command_id"), F.col("user_id").cast("string").alias("session_id"), "ts", F.lit("open").alias("action"), F.col("event_type").alias("question")
    )
    found = sessions.replay(rows, sessions.Limits(TTL, MOST))
    return found.select("command_id", "session_id", "outcome", F.col("evicted").isNotNull().alias("evicts"), "turn_index", "turns_kept")
