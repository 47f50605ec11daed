"""Keyed tables, copies of files, paged listings and the outbox, over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import paging, records
from ..sources import pages, transfer
from ..sources.keyed import Keyed
from ..sources.written import materialize, scratch
from ..streaming import actions
from .registry import query
from .registry import table as _t


def _customers(spark, sf) -> Keyed:
    table = Keyed(scratch(spark), "c_nationkey", "c_name", buckets=32)
    table.write(_t(spark, sf, "customer").select("c_nationkey", "c_name", "c_custkey"))
    return table


@query("SELECT c_nationkey, c_name, c_custkey FROM customer WHERE c_nationkey = (SELECT c_nationkey FROM customer WHERE c_custkey = 77) AND c_name = (SELECT c_name FROM customer WHERE c_custkey = 77)")
def keyed_point(spark, sf):
    one = _t(spark, sf, "customer").where("c_custkey = 77").select("c_nationkey", "c_name").first()
    return _customers(spark, sf).point(spark, one.c_nationkey, one.c_name)


@query("SELECT c_nationkey, c_name, c_custkey FROM customer WHERE c_nationkey = 7 AND starts_with(c_name, 'Customer#0000001')")
def keyed_prefix(spark, sf):
    return _customers(spark, sf).prefix(spark, 7, "Customer#0000001")


@query("SELECT c_nationkey, c_name, c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def keyed_lookup(spark, sf):
    """Customers of pending orders: many lookups at once."""
    c = _t(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_name")
    asked = _t(spark, sf, "orders").where("o_orderstatus = 'P'").join(c, "o_custkey").select("c_nationkey", "c_name")
    return _customers(spark, sf).lookup(asked)


@query("""SELECT CAST(c_nationkey AS VARCHAR) || '/' || c_mktsegment || '.txt' AS name, sum(length(c_name) + 1)::BIGINT AS length,
  sha256(string_agg(c_name || chr(10), '' ORDER BY c_custkey)) AS content FROM customer GROUP BY c_nationkey, c_mktsegment
UNION ALL SELECT 'version.json', 10, sha256('{"v": "7"}')""")
def copied_folder(spark, sf):
    """Customers' names as a file for each nation and segment, copied over an earlier copy that has more."""
    source, target = scratch(spark), scratch(spark)
    names = F.transform(F.sort_array(F.collect_list(F.struct("c_custkey", "c_name"))), lambda x: F.concat(x["c_name"], F.lit("\n")))
    files = _t(spark, sf, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.array_join(names, "").alias("content"))
    files = files.select(F.concat_ws("/", F.col("c_nationkey").cast("string"), F.concat("c_mktsegment", F.lit(".txt"))).alias("name"), "content")
    transfer.write_files(files, source)
    transfer.write_files(files.select(F.concat(F.lit("old/"), "name").alias("name"), "content"), target)
    transfer.copy_folder(spark, source, target, '{"v": "7"}')
    return transfer.listed(spark, target, content=True).select("name", "length", F.sha2("content", 256).alias("content"))


@query("SELECT p_type AS chain, p_partkey, p_name, p_retailprice FROM part")
def paged_parts(spark, sf):
    """Parts as pages of 50 for each type, read back by following the cursors."""
    from ..operators.listing import number_rows

    rows = number_rows(_t(spark, sf, "part").select("p_type", "p_partkey", "p_name", "p_retailprice"), "p_type", "p_partkey", piece=F.shiftright("p_partkey", 14))
    root = scratch(spark)
    transfer.write_files(pages.as_pages(rows, "p_type", "number", paging.encoded), root)
    return pages.paged(spark, root, "p_partkey long not null, p_name string not null, p_retailprice double")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 5 < 3 AND o_custkey >= 1 AND o_custkey < 900 THEN o_custkey END AS at FROM orders")
def page_cursors(spark, sf):
    """Orders' customers as cursors into a list of 900; some are cut off, some no number."""
    k = F.col("o_orderkey")
    said = F.when(k % 5 == 3, F.concat(paging.encoded(F.col("o_custkey")), F.lit("="))).when(k % 5 == 4, paging.encoded(F.concat(F.lit("x"), F.col("o_custkey")))).otherwise(paging.encoded(F.col("o_custkey")))
    cursor = F.when(k % 7 == 0, F.lit("!")).otherwise(said)
    return _t(spark, sf, "orders").select("o_orderkey", paging.decoded(cursor, F.lit(900)).alias("at"))


@query("""WITH l AS (SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, min(event_id) AS seq FROM events GROUP BY ALL)
SELECT user_id, day FROM l WHERE seq % 3 = 0""")
def outbox_resent(spark, sf):
    """Users' days as recorded actions, sent by a sender that fails for every third: the start-up pass, when the last record has waited, finds just those."""
    e = _t(spark, sf, "events").select("user_id", F.date_trunc("day", "ts").cast("date").cast("string").alias("day"), F.col("event_id").alias("seq"), "ts")
    recorded = materialize(e.groupBy("user_id", "day").agg(F.min("seq").alias("seq"), F.min("ts").alias("occurred_at")))
    sent, wait = scratch(spark), F.expr("INTERVAL '5' MINUTE")
    actions.outbox(lambda rows: [r["seq"] % 3 != 0 for r in rows], sent, ["user_id", "day", "seq"])(recorded, 0)
    now = F.lit(recorded.agg(F.max("occurred_at") + wait).first()[0]).cast("timestamp_ntz")
    marks = spark.read.option("basePath", sent).parquet(sent).select("user_id", "day", "seq", now.alias("occurred_at"), F.lit("sent").alias("event"))
    events = recorded.withColumn("event", F.lit("recorded")).unionByName(marks)
    ledger = records.fold_ledger(events.withColumn("subscriber", F.lit(None).cast("string")), ["user_id", "day"])
    _, again = records.start_up(ledger, now, F.expr("INTERVAL '7' DAY"), wait, wait)
    return again.select("user_id", "day")


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
s AS (SELECT event_id, user_id, n, t AS a, 1 AS c FROM e WHERE n = 1
  UNION ALL SELECT e.event_id, e.user_id, e.n, CASE WHEN e.t >= s.a + 86400000000 THEN e.t ELSE s.a END, CASE WHEN e.t >= s.a + 86400000000 THEN 1 ELSE s.c + 1 END FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1)
SELECT event_id, user_id, c <= 3 AS admitted FROM s""")
def limit_from_first_use(spark, sf):
    return records.used_window(_t(spark, sf, "events").select("event_id", "user_id", "ts"), "user_id", "ts", "event_id", 86400, 3).select("event_id", "user_id", "admitted")
