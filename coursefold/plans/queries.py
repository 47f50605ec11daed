"""The engine's operators applied to the given tables, each with the SQL that says the same."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys, text, tokens
from ..operators import fold, listing, paging, records, tenants, timeline
from ..sources import files
from ..sources.files import prefix_scan
from . import file_queries, rule_queries, source_queries, store_queries, tenant_queries  # noqa: F401  they register theirs
from .registry import ORACLE_SQL, QUERIES, query  # noqa: F401
from .registry import table as _t


def _chapters(spark: SparkSession, sf: str) -> DataFrame:
    """Customers and parts as chapters of a nation; a customer's orders are attempts, lineitems checks. No order is of a part, so these are not started."""
    c = _t(spark, sf, "customer").select(F.col("c_nationkey").alias("subject_id"), F.col("c_custkey").alias("chapter_id"), F.col("c_name").alias("title"))
    p = _t(spark, sf, "part").select((F.col("p_partkey") % 25).cast("int").alias("subject_id"), (-1 - F.col("p_partkey")).alias("chapter_id"), F.col("p_name").alias("title"))
    c = c.withColumn("subject_id", F.col("subject_id").cast("int")).unionByName(p)
    c = listing.number_rows(c, "subject_id", "chapter_id", piece=F.shiftright("chapter_id", 14))
    o = _t(spark, sf, "orders")
    last = listing.latest(o.withColumnRenamed("o_custkey", "chapter_id"), "chapter_id", F.struct("o_orderdate", "o_orderkey"), "o_orderkey", "o_orderstatus")
    items = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    checked = last.where("o_orderstatus = 'F'").select("o_orderkey").join(items, "o_orderkey", "left_semi").withColumn("has", F.lit(1))
    p = last.join(checked, "o_orderkey", "left")
    state = text.chapter_state(F.coalesce("has", F.lit(0)), F.when(F.col("o_orderstatus") == "O", 1).otherwise(0), F.lit(1))
    return listing.with_progress(c, p.select("chapter_id", "attempt_count", state.alias("state")), "chapter_id")


_LISTING = """
WITH x AS (SELECT CAST(c_nationkey AS INT) AS subject_id, c_custkey AS chapter_id, c_name AS title FROM customer UNION ALL SELECT CAST(p_partkey % 25 AS INT), -1 - p_partkey, p_name FROM part),
c AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY chapter_id) AS number FROM x),
o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n, count(*) OVER (PARTITION BY o_custkey) AS k FROM orders),
l AS (SELECT c.*, coalesce(o.k, 0) AS attempt_count, CASE WHEN o.o_orderkey IS NULL THEN 'not-started'
  WHEN o.o_orderstatus = 'F' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o.o_orderkey) THEN 'checked'
  WHEN o.o_orderstatus = 'O' THEN 'taught' ELSE 'planned' END AS state
  FROM c LEFT JOIN o ON o.o_custkey = c.chapter_id AND o.n = 1)
"""


@query(_LISTING + "SELECT * FROM l")
def chapters_listing(spark, sf):
    return _chapters(spark, sf)


@query(_LISTING + """SELECT subject_id, count(*) AS chapters, count(*) FILTER (WHERE state = 'not-started') AS not_started, count(*) FILTER (WHERE state = 'planned') AS planned,
  count(*) FILTER (WHERE state = 'taught') AS taught, count(*) FILTER (WHERE state = 'checked') AS checked FROM l GROUP BY subject_id""")
def subject_progress(spark, sf):
    return listing.count_states(_chapters(spark, sf), "subject_id")


@query(_LISTING + "SELECT subject_id, (number - 1) // 1000 * 1000 + 1 AS first, string_agg(state, ',' ORDER BY number) AS states FROM l GROUP BY ALL")
def subject_states(spark, sf):
    return listing.states_in_order(_chapters(spark, sf), "subject_id")


@query(_LISTING + """SELECT chapter_id, state || CASE WHEN attempt_count > 1 THEN ' · attempt ' || attempt_count ELSE '' END
  || CASE WHEN state = 'planned' THEN ' · 0 of 1' ELSE '' END AS line,
  CASE state WHEN 'not-started' THEN 0 WHEN 'planned' THEN 1 WHEN 'taught' THEN 2 ELSE 3 END AS steps FROM l""")
def state_line(spark, sf):
    rows = _chapters(spark, sf)
    return rows.select("chapter_id", text.state_line(F.col("state"), F.col("attempt_count"), F.lit(0), F.lit(1)).alias("line"), text.state_rank(F.col("state")).alias("steps"))


@query(_LISTING + "SELECT subject_id, state, count(*) AS count FROM l GROUP BY ALL")
def legend_rows(spark, sf):
    return listing.legend(_chapters(spark, sf), "subject_id")


@query(_LISTING + "SELECT subject_id, count(*) FILTER (WHERE state = 'checked') AS x, count(*) AS n FROM l GROUP BY subject_id")
def checked_of_all(spark, sf):
    return listing.x_of_n(_chapters(spark, sf), "subject_id")


_PARTS = "SELECT p_partkey, p_type, p_name, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS number FROM part"


def _found(spark, sf):
    parts = listing.number_rows(_t(spark, sf, "part").select("p_partkey", "p_type", "p_name"), "p_type", "p_partkey", piece=F.shiftright("p_partkey", 14))
    return listing.search(parts, "p_name", " WID ")


@query(f"SELECT * FROM ({_PARTS}) WHERE contains(lower(p_name), 'wid')")
def chapters_search(spark, sf):
    return _found(spark, sf)


@query(f"SELECT * FROM ({_PARTS}) WHERE contains(lower(p_name), 'wid') ORDER BY p_type, number LIMIT 50 OFFSET 50")
def chapters_search_page(spark, sf):
    rows = _found(spark, sf)
    first, cursor = paging.page(rows, ["p_type", "number"], 50)
    return paging.page(rows, ["p_type", "number"], 50, cursor)[0] if cursor else first.limit(0)


@query("SELECT l_orderkey AS subject_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS place, l_partkey AS chapter_id FROM lineitem")
def chapter_place(spark, sf):
    nested = _t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("subject_id")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("chapters"))
    return listing.place_of(nested, "subject_id", "chapters").select("subject_id", "place", F.col("item.l_partkey").alias("chapter_id"))


@query("""SELECT l_partkey AS chapter_id, min(l_orderkey) AS subject_id, min_by(place, (l_orderkey, place)) AS place FROM (
  SELECT l_partkey, l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS place FROM lineitem) GROUP BY l_partkey""")
def chapter_first_place(spark, sf):
    nested = _t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("subject_id")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("chapters"))
    places = listing.place_of(nested, "subject_id", "chapters")
    return listing.first_place(places, F.col("item.l_partkey"), "subject_id", "place").select(F.col("item").alias("chapter_id"), "subject_id", "place")


@query("""WITH i AS (SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus <> 'O'), w AS (SELECT o_custkey, max(o_orderkey) AS k FROM orders GROUP BY o_custkey)
SELECT o_custkey, coalesce(max(o_orderkey) FILTER (WHERE o_orderkey = k), min(o_orderkey)) AS o_orderkey FROM i JOIN w USING (o_custkey) GROUP BY o_custkey""")
def active_choice(spark, sf):
    o = _t(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    wanted = o.groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey"))
    return listing.chosen_or_first(o.where("o_orderstatus <> 'O'"), wanted, "o_custkey", "o_orderkey", "o_orderkey")


def _checks(spark, sf):
    o = _t(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    o = listing.number_rows(o, "o_custkey", "o_orderdate", "o_orderkey", name="attempt")
    items = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    return o, listing.number_rows(items, "o_orderkey", "l_linenumber", "l_partkey", "l_suppkey", name="check_number")


@query("""WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS attempt FROM orders),
l AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS check_number FROM lineitem)
SELECT o_custkey, attempt, o_orderkey, check_number, l_partkey FROM o LEFT JOIN l ON l_orderkey = o_orderkey""")
def history_flat(spark, sf):
    o, items = _checks(spark, sf)
    return o.join(items, "o_orderkey", "left").select("o_custkey", "attempt", "o_orderkey", "check_number", "l_partkey")


@query("""WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS attempt FROM orders),
n AS (SELECT l_orderkey, l_partkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS check_number FROM lineitem),
l AS (SELECT l_orderkey, list({'check_number': check_number, 'l_partkey': l_partkey, 'l_returnflag': l_returnflag} ORDER BY check_number DESC) AS checks,
  coalesce(list({'number': check_number, 'part': l_partkey} ORDER BY check_number DESC) FILTER (WHERE l_returnflag = 'R'), []) AS wrong FROM n GROUP BY l_orderkey)
SELECT o_custkey, attempt, o_orderkey, CAST(to_json(checks) AS VARCHAR) AS checks, CAST(to_json(wrong) AS VARCHAR) AS wrong FROM o LEFT JOIN l ON l_orderkey = o_orderkey""")
def history_nested(spark, sf):
    o, items = _checks(spark, sf)
    checks = items.groupBy("o_orderkey").agg(F.sort_array(F.collect_list(F.struct("check_number", "l_partkey", "l_returnflag")), asc=False).alias("checks"))
    wrong = F.transform(F.filter("checks", lambda c: c["l_returnflag"] == "R"), lambda c: F.struct(c["check_number"].alias("number"), c["l_partkey"].alias("part")))
    return o.join(checks, "o_orderkey", "left").select("o_custkey", "attempt", "o_orderkey", text.compact_json(F.col("checks")).alias("checks"), text.compact_json(wrong).alias("wrong"))


@query("SELECT o_orderkey, count(l_orderkey) FILTER (WHERE l_returnflag <> 'R') AS right_count, count(l_orderkey) AS of_count FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def check_scores(spark, sf):
    answers = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag")
    return listing.check_scores(_t(spark, sf, "orders"), answers, "o_orderkey", F.col("l_returnflag") == "R")


_CHAPTER = {"family_id": "user_id div 30", "child_id": "user_id % 3", "class_level": "1 + user_id % 2", "chapter_id": "user_id % 10"}
_CHAPTER_SQL = "chapter_id // 30 AS family_id, chapter_id % 3 AS child_id, 1 + chapter_id % 2 AS class_level, chapter_id % 10 AS chapter_id"


def progress_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events as learning progress, k of the properties giving ids and counts. A user is one chapter of a child.

    No single column of the key tells two users apart, nor do three of the four.
    """
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.when(F.col("event_type") == "signup", "plan").when(F.col("event_type").isin("view", "click"), "concept").when(F.col("event_type") == "purchase", "check")
    e = _t(spark, sf, "events").select(*(F.expr(f"{e} AS {name}") for name, e in _CHAPTER.items()), F.col("event_id").alias("seq"), F.col("ts").alias("occurred_at"), kind.alias("kind"), k.alias("k")).where("kind is not null")
    plan, concept, check = (F.col("kind") == x for x in ("plan", "concept", "check"))
    return e.select(*fold.CHAPTER, "seq", "occurred_at", "kind", F.when(plan, F.concat(F.lit("p"), F.col("k") % 3)).alias("plan_id"), F.when(plan, F.col("k") % 5).alias("concept_count"), F.when(concept, F.concat(F.lit("c"), F.col("k") % 6)).alias("concept_id"), F.when(check, F.concat(F.lit("q"), F.col("k"))).alias("check_id"), F.when(check, F.col("k") % 2).alias("right_count"), F.when(check, F.lit(1)).alias("of_count"))


_FOLD = """
WITH e AS (SELECT user_id AS chapter_id, event_id AS seq, ts, CAST(json_extract_string(props, '$.k') AS INT) AS k,
  CASE event_type WHEN 'signup' THEN 'plan' WHEN 'view' THEN 'concept' WHEN 'click' THEN 'concept' WHEN 'purchase' THEN 'check' END AS kind FROM events),
p AS (SELECT chapter_id, seq, k, lag(k % 3) OVER (PARTITION BY chapter_id ORDER BY seq) AS b FROM e WHERE kind = 'plan'),
s AS (SELECT chapter_id, seq FROM p WHERE b IS NULL OR b <> k % 3),
n AS (SELECT e.*, s.seq IS NOT NULL AS starts, count(s.seq) OVER (PARTITION BY e.chapter_id ORDER BY e.seq) AS attempt FROM e LEFT JOIN s USING (chapter_id, seq) WHERE kind IS NOT NULL),
m AS (SELECT *, max(k % 5) FILTER (WHERE starts) OVER (PARTITION BY chapter_id, attempt) AS planned FROM n WHERE attempt > 0),
f AS (SELECT *, row_number() OVER (PARTITION BY chapter_id, attempt, kind, CASE kind WHEN 'concept' THEN k % 6 WHEN 'check' THEN k END ORDER BY seq) AS r FROM m WHERE starts OR kind <> 'plan'),
g AS (SELECT *, row_number() OVER (PARTITION BY chapter_id, attempt, kind ORDER BY seq) AS num FROM f WHERE starts OR r = 1),
a AS (SELECT * FROM g WHERE kind <> 'concept' OR num <= planned),
t AS (SELECT chapter_id, attempt, max(planned) AS cc, count(*) FILTER (WHERE kind = 'concept') AS cd, count(*) FILTER (WHERE kind = 'check') AS ck FROM a GROUP BY ALL)
"""


@query(_FOLD + """, u AS (SELECT chapter_id, max(attempt) AS attempt_count, max_by(cc, attempt) AS concept_count, max_by(cd, attempt) AS concepts_done, max_by(ck, attempt) AS latest_checks, CAST(sum(ck) AS BIGINT) AS check_count FROM t GROUP BY chapter_id),
c AS (SELECT chapter_id, max_by(ts, seq) AS last_activity, max_by(k % 2, seq) FILTER (WHERE kind = 'check') AS latest_right, CASE WHEN count(*) FILTER (WHERE kind = 'check') > 0 THEN 1 END AS latest_of FROM a GROUP BY chapter_id)
SELECT """ + _CHAPTER_SQL + """, attempt_count, CAST(concept_count AS BIGINT) AS concept_count, concepts_done, latest_checks, check_count, CAST(latest_right AS BIGINT) AS latest_right, CAST(latest_of AS BIGINT) AS latest_of, last_activity,
  CASE WHEN latest_checks > 0 THEN 'checked' WHEN concept_count > 0 AND concepts_done >= concept_count THEN 'taught' ELSE 'planned' END AS state FROM u JOIN c USING (chapter_id)""")
def progress_fold(spark, sf):
    return fold.summaries(progress_events(spark, sf))


@query(_FOLD + f"SELECT {_CHAPTER_SQL}, attempt, CAST(cc AS BIGINT) AS concept_count, cd AS concepts_done, ck AS checks FROM t")
def progress_attempts(spark, sf):
    rows = fold.history(progress_events(spark, sf))
    return rows.select(*fold.CHAPTER, F.col("attempt").cast("long"), F.col("concept_count").cast("long"), F.size("done").cast("long").alias("concepts_done"), F.size("checks").cast("long").alias("checks"))


def ledger_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events as an action ledger: an action is a user's day, its first event records it."""
    e = _t(spark, sf, "events").select("user_id", F.date_trunc("day", "ts").cast("date").alias("day"), F.col("event_id").alias("seq"), F.col("ts").alias("occurred_at"), "event_type")
    first = e.groupBy("user_id", "day").agg(F.min_by(F.struct("seq", "occurred_at"), "seq").alias("r")).select("user_id", "day", "r.*", F.lit("recorded").alias("event"), F.lit(None).cast("string").alias("subscriber"))
    kind = F.when(F.col("event_type") == "purchase", "confirmed").when(F.col("event_type") == "error", "done").when(F.col("event_type") == "click", "sent")
    rest = e.select("user_id", "day", "seq", "occurred_at", kind.alias("event"), F.when(kind == "done", F.concat(F.lit("s"), F.col("seq") % 3)).alias("subscriber")).where("event is not null")
    return first.unionByName(rest)


_LEDGER = """
WITH g AS (SELECT user_id, CAST(ts AS DATE) AS day, min(ts) AS recorded_at, coalesce(max_by(ts, event_id) FILTER (WHERE event_type = 'click'), min(ts)) AS last_sent_at, max_by(ts, event_id) FILTER (WHERE event_type = 'purchase') AS confirmed_at,
  coalesce(any_value(d.done), '') AS done
  FROM events LEFT JOIN (SELECT user_id AS u, day AS y, string_agg(s, ',' ORDER BY first) AS done FROM (
    SELECT user_id, CAST(ts AS DATE) AS day, 's' || event_id % 3 AS s, min(event_id) AS first FROM events WHERE event_type = 'error' GROUP BY ALL) GROUP BY ALL) d ON u = user_id AND y = CAST(ts AS DATE)
  GROUP BY user_id, CAST(ts AS DATE))
"""
_NOW = "2024-01-31 00:00:00"


def _now(shift: str):
    return F.lit(_NOW).cast("timestamp_ntz") - F.expr(f"INTERVAL {shift}")


@query(_LEDGER + f"SELECT user_id, CAST(day AS VARCHAR) AS day, recorded_at, last_sent_at, confirmed_at FROM g WHERE done = '' AND last_sent_at <= TIMESTAMP '{_NOW}' - CASE WHEN confirmed_at IS NULL THEN INTERVAL 5 MINUTE ELSE INTERVAL 10 DAY END")
def ledger_resendable(spark, sf):
    rows = records.fold_ledger(ledger_events(spark, sf), ["user_id", "day"])
    return records.resendable(rows, _now("'5' MINUTE"), _now("'10' DAY")).select("user_id", F.col("day").cast("string"), "recorded_at", "last_sent_at", "confirmed_at")


@query(_LEDGER + f"SELECT user_id, CAST(day AS VARCHAR) AS day, recorded_at, done FROM g WHERE recorded_at <= TIMESTAMP '{_NOW}' - INTERVAL 7 DAY AND done <> ''")
def ledger_expired(spark, sf):
    rows = records.fold_ledger(ledger_events(spark, sf), ["user_id", "day"])
    return records.expired(rows, _now("'7' DAY")).select("user_id", F.col("day").cast("string"), "recorded_at", F.array_join("done_by", ",").alias("done"))


@query(_LEDGER + "SELECT e.event_id, e.user_id, 's' || event_id % 3 AS subscriber FROM events e JOIN g ON g.user_id = e.user_id AND g.day = CAST(e.ts AS DATE) WHERE e.event_type = 'view' AND NOT contains(g.done, 's' || event_id % 3)")
def ledger_pending(spark, sf):
    rows = records.fold_ledger(ledger_events(spark, sf), ["user_id", "day"])
    sent = _t(spark, sf, "events").where("event_type = 'view'").select("event_id", "user_id", F.date_trunc("day", "ts").cast("date").alias("day"), F.concat(F.lit("s"), F.col("event_id") % 3).alias("subscriber"))
    return records.pending(sent, rows, ["user_id", "day"]).select("event_id", "user_id", "subscriber")


@query("SELECT min(doc_id) AS doc_id, text AS body, min_by(lang, doc_id) AS lang FROM documents GROUP BY text")
def first_wins(spark, sf):
    rows = _t(spark, sf, "documents").select("doc_id", F.col("text").alias("body"), "lang")
    return records.first_wins(rows, ["body"], "doc_id").select("doc_id", "body", "lang")


def _edits(spark, sf):
    """Customers as rows, those of one segment being deleted, and suppliers as edits of some, a debt being no balance."""
    c = _t(spark, sf, "customer").withColumn("status", F.when(F.col("c_mktsegment") == "BUILDING", "deleting").otherwise("active"))
    sent = _t(spark, sf, "supplier").select((F.col("s_suppkey") * 20).alias("c_custkey"), F.col("s_nationkey").alias("c_nationkey"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("c_acctbal"))
    return c, sent


@query("""SELECT c_custkey, c_name, c_mktsegment, CASE WHEN c_mktsegment = 'BUILDING' THEN 'deleting' ELSE 'active' END AS status,
  CASE WHEN s_suppkey IS NULL OR c_mktsegment = 'BUILDING' THEN c_nationkey ELSE s_nationkey END AS c_nationkey,
  CASE WHEN s_suppkey IS NULL OR c_mktsegment = 'BUILDING' THEN c_acctbal WHEN s_acctbal > 0 THEN s_acctbal END AS c_acctbal FROM customer LEFT JOIN supplier ON s_suppkey * 20 = c_custkey""")
def edit_merge(spark, sf):
    c, sent = _edits(spark, sf)
    return tenants.edit(c, sent, ["c_custkey"], ["c_nationkey", "c_acctbal"])


@query("SELECT s_suppkey * 20 AS c_custkey, CASE WHEN c_custkey IS NULL THEN 'child-not-found' ELSE 'child-deleting' END AS reason FROM supplier LEFT JOIN customer ON s_suppkey * 20 = c_custkey WHERE c_custkey IS NULL OR c_mktsegment = 'BUILDING'")
def edit_refused(spark, sf):
    return tenants.refused_edits(*_edits(spark, sf), ["c_custkey"])


@query("""SELECT c_custkey, coalesce(s_nationkey, c_nationkey) AS merged_nation, CASE WHEN s_acctbal > 0 THEN s_acctbal ELSE c_acctbal END AS merged_balance, CASE WHEN s_suppkey IS NULL THEN c_name END AS replaced_name,
  CASE WHEN s_suppkey IS NULL THEN c_acctbal WHEN s_acctbal > 0 THEN s_acctbal END AS replaced_balance FROM customer LEFT JOIN supplier ON s_suppkey * 20 = c_custkey""")
def update_rows(spark, sf):
    c, sent = _edits(spark, sf)
    merged = records.update(c, sent, ["c_custkey"]).select("c_custkey", F.col("c_nationkey").alias("merged_nation"), F.col("c_acctbal").alias("merged_balance"))
    replaced = records.update(c, sent, ["c_custkey"], replace=True).select("c_custkey", F.col("c_name").alias("replaced_name"), F.col("c_acctbal").alias("replaced_balance"))
    return merged.join(replaced, "c_custkey")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def unbuilt_semi(spark, sf):
    return records.held(_t(spark, sf, "documents").select("doc_id", "lang"), _t(spark, sf, "labels"), ["doc_id"])


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unbuilt_anti(spark, sf):
    return records.insert_new(_t(spark, sf, "labels"), _t(spark, sf, "documents").select("doc_id", "lang"), ["doc_id"])


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def leftovers(spark, sf):
    return records.without(_t(spark, sf, "orders").select("o_orderkey"), _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


@query("SELECT doc_id, n_chars AS before, CASE WHEN quality IS NULL THEN n_chars WHEN quality = 1 THEN n_chars + 1 END AS after FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL")
def snapshot_diff(spark, sf):
    docs = _t(spark, sf, "documents").select("doc_id", "n_chars")
    marked = docs.join(_t(spark, sf, "labels"), "doc_id", "left")
    later = marked.where("quality is null or quality = 1").select("doc_id", (F.col("n_chars") + F.coalesce("quality", F.lit(0))).alias("n_chars"))
    return records.snapshot_diff(docs, later, "doc_id", "n_chars")


@query("SELECT c_custkey, c_name FROM customer WHERE starts_with(c_name, 'Customer#0000001')")
def prefix_names(spark, sf):
    return prefix_scan(_t(spark, sf, "customer").select("c_custkey", "c_name"), "c_name", "Customer#0000001")


@query(r"SELECT regexp_extract(url, '^[a-z]+://([^/]+)/([^/?#]*)', 1) AS host, regexp_extract(url, '^[a-z]+://([^/]+)/([^/?#]*)', 2) AS folder, count(*) AS files FROM pages GROUP BY 1, 2")
def path_counts(spark, sf):
    return files.path_counts(_t(spark, sf, "pages"))


@query("SELECT c_custkey, c_name, n_name, r_name FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
def tenant_chain(spark, sf):
    r, n = _t(spark, sf, "region"), _t(spark, sf, "nation")
    rows = tenants.chain(_t(spark, sf, "customer"), (n, "c_nationkey", "n_nationkey"), (r, "n_regionkey", "r_regionkey"))
    return rows.select("c_custkey", "c_name", "n_name", "r_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def tenant_scope(spark, sf):
    mine = _t(spark, sf, "nation").where("n_regionkey = 2")
    return tenants.within(_t(spark, sf, "customer"), mine, "c_nationkey", "n_nationkey").select("c_custkey", "c_name")


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING') GROUP BY l_orderkey")
def erase_cascade(spark, sf):
    gone = _t(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    orders = _t(spark, sf, "orders").join(gone, "o_custkey", "left_semi").select(F.col("o_orderkey").alias("l_orderkey"))
    return records.without(_t(spark, sf, "lineitem"), orders, ["l_orderkey"]).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT d.doc_id AS conv_id, coalesce(max(c.turn), -1) + 1 AS next_position FROM documents d LEFT JOIN conversations c ON c.conv_id = d.doc_id GROUP BY d.doc_id")
def next_position(spark, sf):
    return records.next_position(_t(spark, sf, "conversations"), _t(spark, sf, "documents").select(F.col("doc_id").alias("conv_id")).distinct(), "conv_id", "turn")


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id) <= 3 AS admitted FROM events")
def limit_fixed_window(spark, sf):
    return records.fixed_window(_t(spark, sf, "events"), "user_id", "ts", "event_id", "day", 3).select("event_id", "user_id", "admitted")


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
s AS (
  SELECT event_id, user_id, n, t AS a, 1 AS ac, t AS b, 1 AS bc, true AS admitted FROM e WHERE n = 1
  UNION ALL
  SELECT event_id, user_id, n, a, CASE WHEN ok THEN ac + 1 ELSE ac END, b, CASE WHEN ok AND bc < 4 THEN bc + 1 ELSE bc END, ok AND bc < 4 FROM (
    SELECT event_id, user_id, n, a, ac, ok, CASE WHEN ok AND t >= b + 86400000000 THEN t ELSE b END AS b, CASE WHEN ok AND t >= b + 86400000000 THEN 0 ELSE bc END AS bc FROM (
      SELECT event_id, user_id, n, t, a, ac, ac < 2 AS ok, b, bc FROM (
        SELECT e.event_id, e.user_id, e.n, e.t, CASE WHEN e.t >= s.a + 3600000000 THEN e.t ELSE s.a END AS a, CASE WHEN e.t >= s.a + 3600000000 THEN 0 ELSE s.ac END AS ac, s.b, s.bc FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1))))
SELECT event_id, user_id, (SELECT ts FROM events x WHERE x.event_id = s.event_id) AS ts, admitted FROM s""")
def limit_chained(spark, sf):
    return records.chained_limits(_t(spark, sf, "events").select("event_id", "user_id", "ts"), "user_id", "ts", "event_id", [(3600, 2), (86400, 4)])


@query("""WITH b(event_type, queue) AS (VALUES ('view', 'q-read'), ('click', 'q-read'), ('click', 'q-count'), ('purchase', 'q-count'), ('signup', 'q-new'))
SELECT event_id, event_type, coalesce(queue, 'parking') AS queue FROM events LEFT JOIN b USING (event_type)""")
def route_and_park(spark, sf):
    bound = spark.createDataFrame([("view", "q-read"), ("click", "q-read"), ("click", "q-count"), ("purchase", "q-count"), ("signup", "q-new")], "event_type string, queue string")
    return records.route(_t(spark, sf, "events").select("event_id", "event_type"), bound, "event_type")


@query("SELECT event_id, user_id, CASE WHEN event_id % 9 > 6 THEN 'park' WHEN event_type = 'error' THEN 'fail' ELSE 'run' END AS fate FROM events")
def delivery_fate(spark, sf):
    deaths = F.array(F.struct((F.col("event_id") % 9).alias("count")), F.struct(F.lit(0).cast("long").alias("count")))
    return _t(spark, sf, "events").select("event_id", "user_id", records.delivery_fate(records.retry_cycles(deaths), 6, F.col("event_type") != "error").alias("fate"))


@query("SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE b IS DISTINCT FROM event_type")
def change_detect(spark, sf):
    return timeline.changes(_t(spark, sf, "events").select("event_id", "user_id", "event_type"), "user_id", "event_id", "event_type")


@query("SELECT event_id, user_id, CAST(round((epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY event_id)) - epoch_us(ts)) / 1e6) AS BIGINT) AS seconds FROM events")
def visit_seconds(spark, sf):
    return timeline.visits(_t(spark, sf, "events"), "user_id", "event_id", "ts").select("event_id", "user_id", "seconds")


def screen_markers(spark: SparkSession, sf: str) -> DataFrame:
    """Events as markers of a user's screen."""
    e = _t(spark, sf, "events").where("event_type <> 'error'")
    kind = F.when(F.col("event_type") == "click", "leave").when(F.col("event_type") == "purchase", "background").when(F.col("event_type") == "signup", "foreground").otherwise("view")
    return e.withColumn("event", kind)


@query("""WITH RECURSIVE m AS (
  SELECT event_id, user_id, ts, CASE event_type WHEN 'click' THEN 'leave' WHEN 'purchase' THEN 'background' WHEN 'signup' THEN 'foreground' ELSE 'view' END AS e,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type <> 'error'),
s AS (
  SELECT user_id, n, e = 'view' AS listening, CASE WHEN e = 'view' THEN event_id END AS started, e = 'view' AS viewed, CAST(NULL AS BIGINT) AS stopped, ts FROM m WHERE n = 1
  UNION ALL
  SELECT m.user_id, m.n, CASE m.e WHEN 'view' THEN true WHEN 'leave' THEN false ELSE listening END,
    CASE m.e WHEN 'view' THEN m.event_id WHEN 'foreground' THEN CASE WHEN listening THEN coalesce(started, m.event_id) END END, m.e = 'view',
    CASE WHEN m.e <> 'foreground' THEN started END, m.ts FROM s JOIN m ON m.user_id = s.user_id AND m.n = s.n + 1),
b AS (SELECT DISTINCT started AS event_id FROM s WHERE started IS NOT NULL)
SELECT b.event_id, e.user_id, e.event_type = 'view' AS viewed, CAST(round((epoch_us(s.ts) - epoch_us(e.ts)) / 1e6) AS BIGINT) AS seconds
FROM b JOIN events e USING (event_id) LEFT JOIN s ON s.stopped = b.event_id""")
def screen_times(spark, sf):
    return timeline.screen_times(screen_markers(spark, sf), "user_id", "event_id", "ts").select("event_id", "user_id", "viewed", "seconds")


@query("SELECT event_id, CASE WHEN event_type <> 'error' THEN CAST(json_extract_string(props, '$.k') AS INT) END AS k, event_type = 'error' AS empty FROM events")
def parsed_props(spark, sf):
    e = _t(spark, sf, "events")
    said = text.parsed(F.when(F.col("event_type") == "error", " ").otherwise(F.col("props")), "k int")  # an error says nothing
    return e.select("event_id", said["k"].alias("k"), said.isNull().alias("empty"))


@query("SELECT o_custkey, o_orderkey FROM orders o WHERE o_orderkey <> (SELECT max(o_orderkey) FROM orders x WHERE x.o_custkey = o.o_custkey)")
def other_items(spark, sf):
    o = _t(spark, sf, "orders").select("o_custkey", "o_orderkey")
    return tenants.others(o, o.groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey")), "o_custkey", "o_orderkey")


@query("SELECT event_id, user_id FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS a FROM events) WHERE a IS NULL OR a - ts >= INTERVAL 5 MINUTE")
def debounce(spark, sf):
    return timeline.debounced(_t(spark, sf, "events"), "user_id", "event_id", "ts", F.expr("INTERVAL '5' MINUTE")).select("event_id", "user_id")


@query("""WITH r AS (SELECT user_id, event_id, event_type, count(*) FILTER (WHERE event_type <> 'error') OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM events)
SELECT user_id, min(event_id) AS first, count(*) AS failures, least(5.0 * pow(2.0, least(count(*) - 1, 16)), 300.0) AS wait_seconds FROM r WHERE event_type = 'error' GROUP BY user_id, run""")
def failure_runs(spark, sf):
    return timeline.failure_runs(_t(spark, sf, "events"), "user_id", "event_id", F.col("event_type") == "error")


@query("SELECT user_id, max(event_id) AS event_id, max_by(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def newest_result(spark, sf):
    return timeline.newest_result(_t(spark, sf, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'checked' WHEN 'O' THEN 'taught' ELSE 'planned' END AS state, 'class:cbse-' || o_orderkey % 10 AS document,
  'a_' || o_custkey || '_' || lpad(CAST(o_orderkey % 10 AS VARCHAR), 2, '0') || '_ch_' || lpad(CAST(o_orderkey % 900 AS VARCHAR), 3, '0') AS row_key FROM orders""")
def composed_keys(spark, sf):
    s, level = F.col("o_orderstatus"), F.col("o_orderkey") % 10
    state = text.chapter_state(F.when(s == "F", 1).otherwise(0), F.when(s == "O", 1).otherwise(0), F.lit(1))
    return _t(spark, sf, "orders").select("o_orderkey", state.alias("state"), keys.document_id(F.lit("CBSE"), level).alias("document"), keys.attempt_key(F.col("o_custkey").cast("string"), level, F.lit("ch"), F.col("o_orderkey") % 900).alias("row_key"))


@query("SELECT p_type, lower(replace(p_type, ' ', '-')) AS wire, count(*) AS n FROM part GROUP BY p_type")
def wire_names(spark, sf):
    # a class name is its words joined; kebab-casing it gives the wire name back
    camel = F.concat(F.array_join(F.transform(F.split("p_type", " "), F.initcap), ""), F.lit("Function"))
    return _t(spark, sf, "part").groupBy("p_type", keys.kebab(camel).alias("wire")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'consent' WHEN c_mktsegment = 'BUILDING' THEN 'board' WHEN c_custkey % 11 = 0 THEN 'family-id'
  WHEN NOT (c_custkey % 12 BETWEEN 1 AND 10 AND (c_nationkey % 2 = 0 OR c_custkey % 12 <= 5)) OR (c_nationkey % 2 = 1 AND c_custkey % 7 > 5) THEN 'class' END AS reason,
  c_mktsegment AS region, 'v' || c_custkey % 3 AS notice FROM customer""")
def validation_reasons(spark, sf):
    """Two children a registration; of one segment the board is not known, and some ids are of no family. Texts come with white space around."""
    k = F.col("c_custkey")
    board = F.when(F.col("c_nationkey") % 2 == 0, "cbse").otherwise("ssc")
    family = F.when(k % 11 == 0, text.NO_ID).otherwise(F.regexp_replace(F.md5("c_name"), "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5"))
    reason = text.reject_reason(F.col("c_acctbal") >= 0, F.col("c_mktsegment") != "BUILDING", family, board, F.array((k % 12).cast("int"), (k % 7).cast("int") % 10 + F.when(k % 7 == 0, 1).otherwise(0)))
    region, notice = text.registered_texts(F.concat(F.lit("\u00a0 "), "c_mktsegment", F.lit("\t")), F.concat(F.lit("v"), k % 3, F.lit("\u3000")))
    return _t(spark, sf, "customer").select("c_custkey", reason.alias("reason"), region.alias("region"), notice.alias("notice"))


@query("""WITH g AS (SELECT l_orderkey, list(p_name ORDER BY l_linenumber, l_partkey, l_suppkey) AS x FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey)
SELECT l_orderkey, CASE WHEN len(x) = 1 THEN x[1] ELSE array_to_string(x[1:len(x) - 1], ', ') || ' and ' || x[len(x)] END AS names FROM g""")
def name_list(spark, sf):
    named = _t(spark, sf, "lineitem").join(_t(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "p_name"))), lambda x: x["p_name"])
    return named.groupBy("l_orderkey").agg(ordered.alias("x")).select("l_orderkey", text.name_list(F.col("x")).alias("names"))


_SECRET = b"not a secret, only for this query"


def _hmac_sql(purpose: str, message: str) -> str:
    """HMAC-SHA256 of a blob in SQL, as the hash of the outer key and the hash of the inner key and the message."""
    key = tokens.purpose_key(_SECRET, purpose).ljust(hashlib.sha256().block_size, b"\0")
    inner, outer = (bytes(b ^ pad for b in key).hex() for pad in (0x36, 0x5C))
    return f"unhex(sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || {message}))))"


def _url64(blob: str) -> str:
    return f"rtrim(replace(replace(to_base64({blob}), '+', '-'), '/', '_'), '=')"


@query(f"""WITH b AS (SELECT *, {_url64("encode('{\"c_custkey\":' || c_custkey || '}')")} AS body FROM customer)
SELECT c_custkey, lower(hex({_hmac_sql("uid", "encode(c_name)")})) AS uid_hash, body || '.' || {_url64(_hmac_sql("proof", "encode(body || chr(10) || c_name)"))} AS sealed, '{{"c_custkey":' || c_custkey || '}}' AS opened FROM b""")
def keyed_hash(spark, sf):
    who = F.col("c_name")
    sealed = tokens.seal(F.to_json(F.struct("c_custkey")), who, _SECRET, "proof")
    rows = _t(spark, sf, "customer").select("c_custkey", tokens.keyed_hash(who, _SECRET).alias("uid_hash"), sealed.alias("sealed"), "c_name")
    return rows.select("c_custkey", "uid_hash", "sealed", tokens.open_sealed(F.col("sealed"), who, _SECRET, "proof").alias("opened"))
