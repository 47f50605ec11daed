"""Numbered, searchable listings with each chapter's state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import STATES, contains_ignoring_case


def number_rows(rows: DataFrame, group: str, *order: str, name: str = "number", piece: Column | None = None) -> DataFrame:
    """1..N in each group, before any search, so that filtered rows keep their number.

    A group that grows with the data needs ``piece``, a coarser form of the first order column that never falls as that
    grows: rows are numbered within pieces, and the rows of the pieces before are added. No task then holds a group.
    """
    if piece is None:
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long"))
    rows = rows.withColumn("_piece", piece)
    counts = rows.groupBy(group, "_piece").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_piece")) - F.col("_n")
    within = F.row_number().over(Window.partitionBy(group, "_piece").orderBy(*order))
    both = rows.withColumn("_within", within).join(counts.select(group, "_piece", before.alias("_before")), [group, "_piece"])
    return both.withColumn(name, F.col("_before") + F.col("_within")).drop("_piece", "_within", "_before")


def with_progress(chapters: DataFrame, progress: DataFrame, key: str) -> DataFrame:
    """Left join; the progress side has one row a key, and a chapter without one is not started."""
    return chapters.join(progress, key, "left").withColumns({"state": F.coalesce("state", F.lit(STATES[0])), "attempt_count": F.coalesce("attempt_count", F.lit(0)).cast("long")})


def search(rows: DataFrame, title: str, text: str) -> DataFrame:
    return rows.where(contains_ignoring_case(F.col(title), text))


def count_states(rows: DataFrame, group: str) -> DataFrame:
    """Counts per state over whole groups, before search and paging."""
    per = [F.count_if(F.col("state") == s).alias(s.replace("-", "_")) for s in STATES]
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("chapters"), *per)


def states_in_order(rows: DataFrame, group: str, length: int = 1000) -> DataFrame:
    """Each group's states in order, ``length`` of them in a row that says the number of its first."""
    part = F.floor((F.col("number") - 1) / length) * length + 1
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("number", "state"))), lambda x: x["state"])
    return rows.groupBy(group, part.alias("first")).agg(F.array_join(ordered, ",").alias("states"))


def place_of(nested: DataFrame, group: str, items: str) -> DataFrame:
    """Each item of a nested list with its 1-based place."""
    return nested.select(group, F.posexplode(items).alias("pos", "item")).select(group, (F.col("pos") + 1).cast("long").alias("place"), "item")


def check_scores(checks: DataFrame, answers: DataFrame, key: str, wrong: Column) -> DataFrame:
    """(key, right_count, of_count): how many of a check's answers are right, and how many there are; a check without any has 0 of 0."""
    counts = answers.groupBy(key).agg(F.count_if(~wrong).alias("right_count"), F.count(F.lit(1)).alias("of_count"))
    none = F.lit(0).cast("long")
    return checks.select(key).join(counts, key, "left").select(key, F.coalesce("right_count", none).alias("right_count"), F.coalesce("of_count", none).alias("of_count"))


def value_line(rows: DataFrame, group: str, value: str, between: str = " | ") -> DataFrame:
    """Each group's distinct values, of which there are few, sorted, as one line."""
    return rows.groupBy(group).agg(F.array_join(F.sort_array(F.collect_set(value)), between).alias("line"))


def first_place(places: DataFrame, item: Column, *order: str) -> DataFrame:
    """One place for each item: that in the first group in document order, if several hold it."""
    return places.withColumn("_item", item).groupBy("_item").agg(F.min(F.struct(*order, *[c for c in places.columns if c not in (*order, "item")])).alias("_p")).select(F.col("_item").alias("item"), "_p.*")


def headed(places: DataFrame, summaries: DataFrame, key: str) -> DataFrame:
    """Places with what there is of their chapter's summary: without one the chapter is not started and has no attempts."""
    return with_progress(places, summaries, key)


def x_of_n(rows: DataFrame, group: str, state: str = "checked") -> DataFrame:
    return rows.groupBy(group).agg(F.count_if(F.col("state") == state).alias("x"), F.count(F.lit(1)).alias("n"))


def legend(rows: DataFrame, group: str) -> DataFrame:
    """Counts of the states that a group has, in the order of states."""
    return rows.groupBy(group, "state").agg(F.count(F.lit(1)).alias("count"))


def chosen_or_first(items: DataFrame, wanted: DataFrame, group: str, item: str, order: str) -> DataFrame:
    """The wanted item of each group if it is there, else the group's first."""
    first = items.groupBy(group).agg(F.min_by(item, order).alias("first"))
    there = wanted.join(items, [group, item], "left_semi").select(group, F.col(item).alias("wanted"))
    return first.join(there, group, "left").select(group, F.coalesce("wanted", "first").alias(item))


def latest(rows: DataFrame, key: str, order: Column, *columns: str) -> DataFrame:
    """The last row of each key in an explicit order, and how many rows there are."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("last"), F.count(F.lit(1)).alias("attempt_count")).select(key, "last.*", "attempt_count")
