"""Resume, ledgers, retry queues (FIL-11, SRC-12, SNK-03), and streams (an extension)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import incremental as op
from ..streaming import live
from .registry import Plan

plan = Plan()
q = plan.add


@q("fil_11_resume", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) OR c_acctbal < 0")
def fil_11(t):
    done = t.orders.select(F.col("o_custkey").alias("c_custkey")).distinct()
    return op.pending(t.customer.select("c_custkey"), done, "c_custkey", t.customer.filter("c_acctbal < 0"))


@q("src_12_guarded_append", "SELECT user_id, event_type, min(event_id) AS event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND (user_id, event_type) NOT IN (SELECT user_id, event_type FROM events WHERE ts < TIMESTAMP '2024-01-05') GROUP BY ALL")
def src_12(t):
    e = t.events.select("user_id", "event_type", "event_id", "ts")
    return op.append_new(e.filter("ts < TIMESTAMP_NTZ '2024-01-05'"), e.filter("ts >= TIMESTAMP_NTZ '2024-01-05'"), ["user_id", "event_type"], "event_id").drop("ts")


@q("snk_03_failure_table", "WITH o AS (SELECT user_id, event_id, value FROM events WHERE value < 30 AND ts < TIMESTAMP '2024-01-05'), n AS (SELECT user_id, event_id, value FROM events WHERE value < 30 AND ts >= TIMESTAMP '2024-01-05'), u AS (SELECT *, 0 AS r FROM o UNION ALL SELECT *, 1 FROM n), w AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY r DESC, event_id DESC) AS i FROM u) SELECT user_id, event_id, value FROM w WHERE i = 1 AND user_id NOT IN (SELECT user_id FROM events WHERE value > 150)")
def snk_03(t):
    e = t.events.select("user_id", "event_id", "value", "ts")
    bad = e.filter("value < 30")
    return op.merge_failures(bad.filter("ts < TIMESTAMP_NTZ '2024-01-05'"), bad.filter("ts >= TIMESTAMP_NTZ '2024-01-05'"), e.filter("value > 150"), "user_id", "event_id").drop("ts")


@q("ext_stream_windowed_counts", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, floor(avg(value) * 1e6 + 0.5) / 1e6 AS mean FROM events GROUP BY ALL")
def ext_windows(t):
    from ..functions.columns import flat

    w = live.drain(live.windowed_counts(live.read_events(t.spark, t.dir)), "complete")
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", flat(F.col("mean"), 6).alias("mean"))


@q("ext_stream_deduplicated", "SELECT DISTINCT event_id FROM events")
def ext_dedupe(t):
    return live.drain(live.deduplicated(live.read_events(t.spark, t.dir), ["event_id"])).select("event_id")


@q("ext_stream_sessions", "WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, g")
def ext_sessions(t):
    s = live.drain(live.sessions(live.read_events(t.spark, t.dir), "6 hours"), "complete")
    return s.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


QUERIES, SQL = plan.queries, plan.sql
