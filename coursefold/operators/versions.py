"""Conditional writes: what of many writes a store accepts that knows each row's current ETag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chains import reachable

#: What a write is answered.
ACCEPTED, NOT_FOUND, CONFLICT, CHANGED = 204, 404, 409, 412


def conditional_writes(rows: DataFrame, writes: DataFrame, key: list[str], seq: str = "seq") -> DataFrame:
    """``writes`` with ``status``: 204 accepted, 404 no such row, 409 there is one, 412 changed since.

    ``rows``: key and etag of the rows that are there. ``writes``: key, ``seq`` and ``if_match``, the ETag that the writer has read, ``*``
    for any, null for an insert. A write that is accepted makes its ``seq`` the row's ETag, which no row may have had before. An ETag stays the current one until the first
    later write that names it or names any; so each version points to the one write that can follow it, and what a row's first version reaches
    by these pointers is accepted. A key's versions form one chain, or one after each write that names any, all followed in doubling rounds.
    """
    by = Window.partitionBy(*key).orderBy(seq)
    w = writes.join(rows.select(*key, F.col("etag").cast("string").alias("_etag")), key, "left")
    insert = F.col("if_match").isNull()
    # a row is there from the start or from its first insert on
    w = w.withColumn("_born", F.when(F.col("_etag").isNull(), F.min(F.when(insert, F.col(seq))).over(Window.partitionBy(*key))))
    there = F.col("_etag").isNotNull() | F.coalesce(F.col(seq) > F.col("_born"), F.lit(False))
    starts = (insert & (F.col(seq) == F.col("_born"))) | (there & (F.col("if_match") == "*"))
    w = w.withColumn("_there", there).withColumn("_starts", F.coalesce(starts, F.lit(False)))
    w = w.withColumn("_part", F.sum(F.col("_starts").cast("long")).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    id_ = F.col(seq).cast("string")
    # versions of a row before all writes are in part 0; a write names a version of its own part or comes too late
    made = rows.select(*key, F.lit(0).cast("long").alias("_part"), F.col("etag").cast("string").alias("if_match"), F.lit(None).cast(w.schema[seq].dataType).alias("_at"))
    made = made.unionByName(w.select(*key, "_part", id_.alias("if_match"), F.col(seq).alias("_at")))
    named = w.where(F.col("_there") & ~F.col("_starts") & ~insert)
    follows = named.join(made, [*key, "_part", "if_match"]).where(F.col("_at").isNull() | (F.col(seq) > F.col("_at")))
    pointers = follows.groupBy(*key, F.col("if_match").alias("id")).agg(F.min(seq).cast("string").alias("next"))
    roots = rows.select(*key, F.col("etag").cast("string").alias("id")).unionByName(w.where("_starts").select(*key, id_.alias("id")))
    reached = reachable(pointers, roots, key).withColumn("_reached", F.lit(True))
    reached = reached.withColumnRenamed("id", "_id")
    out = w.withColumn("_id", id_).join(reached, [*key, "_id"], "left")
    status = F.when(F.col("_reached"), ACCEPTED).when(insert, CONFLICT).when(~F.col("_there"), NOT_FOUND).otherwise(CHANGED)
    return out.select(*writes.columns, status.alias("status"))


def rows_after(rows: DataFrame, judged: DataFrame, key: list[str], columns: list[str], seq: str = "seq") -> DataFrame:
    """Each key's row once its accepted writes are in: key, ``etag`` and ``columns``.

    ``judged``: writes with their ``status``, ``mode`` (replace or merge) and ``columns``. A replace sets all columns, a null too; a merge leaves those
    that it has no value for. An insert replaces. So a column holds what was last sent since the last replace.
    """
    taken = judged.where(F.col("status") == ACCEPTED).withColumn("_whole", (F.col("mode") == "replace") | F.col("if_match").isNull())
    taken = taken.select(*key, F.col(seq).alias("_seq"), F.col(seq).cast("string").alias("etag"), "_whole", *columns)
    start = rows.select(*key, F.lit(None).cast(taken.schema["_seq"].dataType).alias("_seq"), F.col("etag").cast("string").alias("etag"), F.lit(True).alias("_whole"), *columns)
    order = F.struct(F.col("_seq").isNotNull().alias("later"), "_seq")  # what was there comes before all writes
    every = start.unionByName(taken).withColumn("_order", order)
    since = every.groupBy(*key).agg(F.max(F.when(F.col("_whole"), F.col("_order"))).alias("_since"))
    every = every.join(since, key).where(F.col("_order") >= F.col("_since"))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_order"))).alias(c)
    return every.groupBy(*key).agg(F.max_by("etag", "_order").alias("etag"), *map(last, columns))


def retried(judged: DataFrame, key: list[str], most: int, seq: str = "seq") -> DataFrame:
    """Refused updates (412) with ``tries`` and ``accepted``: each reads the row again and writes again, ``most`` times at most.

    All of a key's refused writers read the same version in a pass, the first in ``seq`` wins it and the others go on to the next pass;
    so the n-th of them is accepted at its n-th try. A try that reads after all others have ended always wins.
    """
    n = F.row_number().over(Window.partitionBy(*key).orderBy(seq))
    refused = judged.where(F.col("status") == CHANGED).withColumn("_n", n)
    return refused.withColumn("tries", F.least(F.col("_n"), F.lit(most))).withColumn("accepted", F.col("_n") <= most).drop("_n")


def shown(status: Column) -> Column:
    return F.when(status == ACCEPTED, "accepted").when(status == CHANGED, "changed").when(status == NOT_FOUND, "missing").otherwise("exists")
