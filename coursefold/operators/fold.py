"""The progress fold: plan, concept and check events to attempts, checks and one summary a chapter.

Arrival order is ``seq``; event times never order anything. All of it is windows over one
partitioning by chapter, so the events are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import chapter_state

#: A chapter of one child: the same chapter and plan ids occur in other families, children and classes.
CHAPTER = ["family_id", "child_id", "class_level", "chapter_id"]


def accepted(events: DataFrame, chapter: list[str] = CHAPTER) -> DataFrame:
    """Events that change something, with their attempt number, and a check's or concept's number in it.

    ``events``: the ``chapter`` columns, seq, kind (plan, concept, check), occurred_at, plan_id, concept_count, concept_id,
    check_id, right_count, of_count. A plan with the latest attempt's id, a concept or check that the
    attempt has, an event before any plan, a check without questions and a concept past the plan's count
    are left out.
    """
    by = Window.partitionBy(*chapter).orderBy("seq")
    plan = F.col("kind") == "plan"
    before = F.last(F.when(plan, F.col("plan_id")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    e = events.withColumn("starts", plan & ~F.coalesce(before == F.col("plan_id"), F.lit(False)))
    e = e.withColumn("attempt", F.sum(F.col("starts").cast("int")).over(by)).where("attempt > 0")
    e = e.withColumn("planned", F.last(F.when(F.col("starts"), F.col("concept_count")), ignorenulls=True).over(by))
    e = e.where(F.col("starts") | (F.col("kind") == "concept") | ((F.col("kind") == "check") & (F.col("of_count") > 0)))
    same = F.coalesce("concept_id", "check_id", F.lit(""))
    first = Window.partitionBy(*chapter, "attempt", "kind", same).orderBy("seq")
    e = e.withColumn("n", F.row_number().over(first)).where("n = 1")
    number = F.row_number().over(Window.partitionBy(*chapter, "attempt", "kind").orderBy("seq"))
    return e.withColumn("n", number).where((F.col("kind") != "concept") | (F.col("n") <= F.col("planned")))


def summaries(events: DataFrame, chapter: list[str] = CHAPTER) -> DataFrame:
    e = accepted(events, chapter)
    per_attempt = e.groupBy(*chapter, "attempt").agg(F.max("planned").alias("concept_count"), F.count_if(F.col("kind") == "concept").alias("concepts_done"), F.count_if(F.col("kind") == "check").alias("checks"), F.max("seq").alias("seq"), F.max_by("occurred_at", "seq").alias("last_activity"), F.max_by(F.when(F.col("kind") == "check", F.struct("right_count", "of_count")), F.when(F.col("kind") == "check", F.col("seq"))).alias("score"))
    out = per_attempt.groupBy(*chapter).agg(
        F.max("attempt").cast("long").alias("attempt_count"), F.max_by(F.struct("concept_count", "concepts_done", "checks"), "attempt").alias("l"), F.sum("checks").alias("check_count"),
        F.max_by("score", F.when(F.col("score").isNotNull(), F.col("attempt"))).alias("score"), F.max_by("last_activity", "seq").alias("last_activity"),
    )
    return out.select(*chapter, "attempt_count", F.col("l.concept_count").cast("long").alias("concept_count"), F.col("l.concepts_done").alias("concepts_done"), F.col("l.checks").alias("latest_checks"), "check_count", F.col("score.right_count").cast("long").alias("latest_right"), F.col("score.of_count").cast("long").alias("latest_of"), "last_activity", chapter_state(F.col("l.checks"), F.col("l.concepts_done"), F.col("l.concept_count")).alias("state"))


def history(events: DataFrame, chapter: list[str] = CHAPTER) -> DataFrame:
    """One row per attempt with its done concepts and its checks newest first; a caller orders the attempts of a chapter."""
    e = accepted(events, chapter)
    done = F.map_from_entries(F.collect_list(F.when(F.col("kind") == "concept", F.struct("concept_id", "occurred_at"))))
    checks = F.sort_array(F.collect_list(F.when(F.col("kind") == "check", F.struct("n", "check_id", "right_count", "of_count", "occurred_at"))), asc=False)
    rows = e.groupBy(*chapter, "attempt").agg(F.max("planned").alias("concept_count"), done.alias("done"), checks.alias("checks"))
    return rows.withColumn("state", chapter_state(F.size("checks"), F.size("done"), F.col("concept_count")))
