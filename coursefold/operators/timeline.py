"""What a key's events say in order: changes, visits, bursts and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import backoff_seconds


def changes(events: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Events whose value is not that of the event before."""
    return events.withColumn("_b", F.lag(value).over(Window.partitionBy(key).orderBy(order))).where(~F.col("_b").eqNullSafe(F.col(value))).drop("_b")


def visits(events: DataFrame, key: str, order: str, ts: str) -> DataFrame:
    """Seconds until the key's next event; null for its last."""
    after = F.lead(ts).over(Window.partitionBy(key).orderBy(order))
    return events.withColumn("seconds", F.round((F.unix_micros(after.cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))) / 1e6).cast("long"))


def screen_times(markers: DataFrame, key: str, order: str, ts: str, event: str = "event") -> DataFrame:
    """Each stretch of a screen: its start's row, ``viewed``, and its seconds; none while it is open.

    ``event`` is view, leave, background or foreground. A view starts a visit and its clock, and ends one that is still
    open. Going to the background or leaving stops the clock. Coming to the foreground starts it again, as no new view, but only
    within a visit and only if it has stopped: while it runs, or once the screen is left, it changes nothing.
    """
    by = Window.partitionBy(key).orderBy(order)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    # what a state is depends on the last marker that sets it whatever was before, so states need no loop
    last = lambda *kinds: F.last(F.when(F.col(event).isin(*kinds), F.col(event)), ignorenulls=True).over(before)
    resumes = (F.col(event) == "foreground") & (last("view", "leave") == "view") & (last("view", "background", "foreground") == "background")
    back = Window.partitionBy(key).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)  # a frame that only grows takes one step a row
    ends = F.last(F.when(F.col(event) != "foreground", F.col(ts)), ignorenulls=True).over(back)
    timed = markers.withColumn("_end", ends).withColumn("_on", (F.col(event) == "view") | resumes).where("_on")
    seconds = F.round((F.unix_micros(F.col("_end").cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))) / 1e6).cast("long")
    return timed.withColumn("seconds", seconds).withColumn("viewed", F.col(event) == "view").drop("_end", "_on")


def debounced(events: DataFrame, key: str, order: str, ts: str, quiet: Column) -> DataFrame:
    """The last event of each burst: the next one is at least ``quiet`` away, or there is none."""
    w = Window.partitionBy(key).orderBy(order)
    return events.withColumn("_n", F.lead(ts).over(w)).where(F.col("_n").isNull() | (F.col("_n") - F.col(ts) >= quiet)).drop("_n")


def failure_runs(events: DataFrame, key: str, order: str, failed: Column) -> DataFrame:
    """Runs of failures without a success between, and the wait after each run."""
    w = Window.partitionBy(key).orderBy(order)
    e = events.withColumn("_f", failed).withColumn("_run", F.sum((~F.col("_f")).cast("long")).over(w)).where("_f")
    runs = e.groupBy(key, "_run").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("failures"))
    return runs.select(key, "first", "failures", backoff_seconds(F.col("failures")).alias("wait_seconds"))


def newest_result(results: DataFrame, key: str, generation: str) -> DataFrame:
    """Results of older generations are stale."""
    rest = [c for c in results.columns if c not in (key, generation)]
    return results.groupBy(key).agg(F.max(generation).alias(generation), F.max_by(F.struct(*rest), generation).alias("r")).select(key, generation, "r.*")
