"""Conditional writes applied to the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import versions
from .registry import query
from .registry import table as _t


def _writes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Users with an even id as rows of version -1, events as writes.

    A writer has read one of the last three events of its user, whatever became of it, or version -1; an error names any version, and a
    signup of k under 10 inserts.
    """
    k = F.get_json_object("props", "$.k").cast("int")
    e = _t(spark, sf, "events").select("user_id", F.col("event_id").alias("seq"), "event_type", "value", k.alias("k"))
    by = Window.partitionBy("user_id").orderBy("seq")
    read = F.when(F.col("k") % 8 < 6, F.lag("seq", 1).over(by)).when(F.col("k") % 8 == 6, F.lag("seq", 2).over(by)).otherwise(F.lag("seq", 3).over(by))
    named = F.when(F.col("event_type") == "error", "*").when((F.col("event_type") == "signup") & (F.col("k") < 10), None).otherwise(F.coalesce(read, F.lit(-1)).cast("string"))
    mode = F.when(F.col("event_type") == "purchase", "replace").otherwise("merge")
    w = e.select("user_id", "seq", named.alias("if_match"), mode.alias("mode"), F.when(F.col("k") % 3 > 0, F.col("k")).alias("a"), F.when(F.col("k") % 5 > 0, F.col("value")).alias("b"))
    rows = e.where("user_id % 2 = 0").select("user_id").distinct().select("user_id", F.lit("-1").alias("etag"), F.lit(-1).alias("a"), F.lit(None).cast("double").alias("b"))
    return rows, w


_WRITES = """
WITH RECURSIVE e AS (
  SELECT user_id, event_id AS seq, event_type AS t, value, CAST(json_extract_string(props, '$.k') AS INT) AS k, row_number() OVER o AS n,
    lag(event_id, 1) OVER o AS l1, lag(event_id, 2) OVER o AS l2, lag(event_id, 3) OVER o AS l3 FROM events WINDOW o AS (PARTITION BY user_id ORDER BY event_id)),
w AS (SELECT user_id, seq, n, t = 'error' AS anyone, t = 'signup' AND k < 10 AS fresh, coalesce(CASE WHEN k % 8 < 6 THEN l1 WHEN k % 8 = 6 THEN l2 ELSE l3 END, -1) AS named,
  t = 'purchase' AS whole, CASE WHEN k % 3 > 0 THEN k END AS a, CASE WHEN k % 5 > 0 THEN value END AS b FROM e),
s AS (
  SELECT DISTINCT user_id, 0 AS n, CAST(NULL AS BIGINT) AS seq, CASE WHEN user_id % 2 = 0 THEN -1::BIGINT END AS etag, CASE WHEN user_id % 2 = 0 THEN -1 END AS a, CAST(NULL AS DOUBLE) AS b, 0 AS status FROM w
  UNION ALL
  SELECT user_id, n, seq, CASE WHEN ok THEN seq ELSE etag END, CASE WHEN NOT ok THEN a WHEN fresh OR whole THEN na ELSE coalesce(na, a) END,
    CASE WHEN NOT ok THEN b WHEN fresh OR whole THEN nb ELSE coalesce(nb, b) END, CASE WHEN ok THEN 204 WHEN fresh THEN 409 WHEN etag IS NULL THEN 404 ELSE 412 END
  FROM (SELECT w.user_id, w.n, w.seq, s.etag, s.a, s.b, w.fresh, w.whole, w.a AS na, w.b AS nb,
    CASE WHEN w.fresh THEN s.etag IS NULL WHEN s.etag IS NULL THEN false ELSE w.anyone OR w.named = s.etag END AS ok FROM s JOIN w ON w.user_id = s.user_id AND w.n = s.n + 1))
"""


@query(_WRITES + "SELECT user_id, seq, status FROM s WHERE n > 0")
def conditional_writes(spark, sf):
    rows, w = _writes(spark, sf)
    return versions.conditional_writes(rows, w, ["user_id"]).select("user_id", "seq", "status")


@query(_WRITES + "SELECT user_id, CAST(etag AS VARCHAR) AS etag, a, b FROM s WHERE etag IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC) = 1")
def rows_after_writes(spark, sf):
    rows, w = _writes(spark, sf)
    return versions.rows_after(rows, versions.conditional_writes(rows, w, ["user_id"]), ["user_id"], ["a", "b"])


@query(_WRITES + """, r AS (SELECT user_id, seq, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS i FROM s WHERE status = 412)
SELECT user_id, seq, least(i, 12) AS tries, i <= 12 AS accepted FROM r""")
def retried_writes(spark, sf):
    rows, w = _writes(spark, sf)
    return versions.retried(versions.conditional_writes(rows, w, ["user_id"]), ["user_id"], 12).select("user_id", "seq", "tries", "accepted")
