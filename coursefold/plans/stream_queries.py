"""Streams with state over the given tables: events come in slices, and each slice is a run that goes on from the last checkpoint."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fold
from ..streaming import stateful
from .queries import progress_events, screen_markers
from .registry import ORACLE_SQL, query
from .registry import table as _t


@query(ORACLE_SQL["progress_fold"])
def progress_stream(spark, sf):
    rows = stateful.in_slices(progress_events(spark, sf), "seq", 2, stateful.fold_stream, "update")
    return stateful.newest(rows, fold.CHAPTER, F.col("batch")).drop("batch")


@query("SELECT DISTINCT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type AS subscriber FROM events")
def done_once_stream(spark, sf):
    """Events as deliveries of a user's day to the subscriber of their type: each is handled once."""
    e = _t(spark, sf, "events").select("user_id", F.date_trunc("day", "ts").cast("date").cast("string").alias("day"), F.col("event_type").alias("subscriber"), F.col("event_id").alias("seq"))
    rows = stateful.in_slices(e, "seq", 2, lambda s: stateful.once(s, ["subscriber", "user_id", "day"]))
    return rows.select("user_id", "day", "subscriber")


@query("""WITH d AS (SELECT event_id, 's' || event_id % 3 AS queue, event_id % 5 AS cycles, epoch_ms(ts) AS died FROM events WHERE event_type = 'error')
SELECT event_id, queue, cycles + 1 AS cycles FROM d WHERE died + 864000000 < (SELECT max(died) FROM d)""")
def delay_queue_stream(spark, sf):
    """Failing deliveries that wait ten days: those that have waited when the last failure comes are back in their own queue."""
    dead = _t(spark, sf, "events").where("event_type = 'error'").select("event_id", F.concat(F.lit("s"), F.col("event_id") % 3).alias("queue"), (F.col("event_id") % 5).alias("cycles"), F.col("ts").cast("timestamp").alias("died_at"))
    rows = stateful.in_slices(dead, "event_id", 2, lambda s: stateful.delayed(s.withWatermark("died_at", "0 seconds"), ["queue", "event_id"], 864_000_000, "died_at"))
    return rows.select("event_id", "queue", "cycles")


@query(f"SELECT * FROM ({ORACLE_SQL['screen_times']}) WHERE seconds IS NOT NULL")
def screen_times_stream(spark, sf):
    """As ``screen_times``, for stretches that have ended; a marker of no user, a day after all others have passed, lets the last ones pass.

    The watermark allows an hour more than the second slice is late by, so no marker is dropped where times do not rise with ids.
    """
    m = screen_markers(spark, sf).select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "event")
    past = F.max("ts") + (F.max("ts") - F.min("ts")) + F.expr("INTERVAL '1' DAY")
    end = m.agg(F.lit(None).cast("long").alias("user_id"), (F.max("event_id") + 1).alias("event_id"), past.alias("ts"), F.lit("background").alias("event"))
    rows = m.unionByName(end)
    allowed, slots = f"{3600 + stateful.late_by(rows, 'event_id', 2, 'ts')} seconds", max(64, m.count() // 20_000)
    out = stateful.in_slices(rows, "event_id", 2, lambda s: stateful.screen_stream(s.withWatermark("ts", allowed), "user_id", "event_id", "ts", slots=slots))
    return out.select("event_id", "user_id", "viewed", "seconds")


@query(ORACLE_SQL["change_detect"])
def change_stream(spark, sf):
    e = _t(spark, sf, "events").select("event_id", "user_id", "event_type")
    return stateful.in_slices(e, "event_id", 2, lambda s: stateful.change_stream(s, "user_id", "event_id", "event_type")).drop("batch")
