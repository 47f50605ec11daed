"""Text, time and file rules and deliveries, applied to the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys, text, tokens
from ..operators import records
from ..sources import files
from ..sources.written import scratch
from ..streaming import actions
from .registry import query
from .registry import table as _t


@query("""SELECT event_id, CASE WHEN hour(ts) < 12 THEN 'morning' WHEN hour(ts) < 17 THEN 'afternoon' ELSE 'evening' END AS part, strftime(ts, '%-d %b') AS day,
  CAST(greatest(ceil((epoch_ms(TIMESTAMP '2024-01-15') - epoch_us(ts) // 1000) / 1000.0), 0) AS BIGINT) AS wait FROM events""")
def time_rules(spark, sf):
    until = F.lit("2024-01-15").cast("timestamp")
    ts = F.col("ts").cast("timestamp")
    return _t(spark, sf, "events").select("event_id", text.day_part(ts).alias("part"), text.short_date(ts).alias("day"), text.seconds_left(until, ts).cast("long").alias("wait"))


@query(r"""SELECT page_id, regexp_full_match(regexp_extract(url, '[^/]*$'), '[A-Za-z0-9._-]+') AS is_id, regexp_full_match(regexp_extract(url, '[^/]*$'), '[a-z0-9]+(-[a-z0-9]+)*') AS kebab,
  regexp_extract(url, '^[a-z]+://([^/]+)', 1) || '_' || page_id AS action, CASE WHEN regexp_extract(url, '^([a-z]+)://', 1) IN ('https', 'http') THEN regexp_extract(url, '^([a-z]+)://', 1) ELSE 'other' END AS scheme FROM pages""")
def path_rules(spark, sf):
    last, scheme = F.regexp_extract("url", "([^/]*)$", 1), F.regexp_extract("url", "^([a-z]+)://", 1)
    action = keys.action_id(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1), F.col("page_id").cast("string"))
    return _t(spark, sf, "pages").select("page_id", keys.is_book_id(last).alias("is_id"), text.is_kebab(last).alias("kebab"), action.alias("action"), text.listed_or(scheme, ["https", "http"], "other").alias("scheme"))


@query(r"""WITH c AS (SELECT c_custkey AS k, c_name, c_mktsegment, CASE c_custkey % 4 WHEN 0 THEN lpad(CAST(c_custkey % 1000000 AS VARCHAR), 6, '0') WHEN 1 THEN CAST(c_custkey AS VARCHAR) WHEN 2 THEN '12 34-' || c_custkey ELSE 'a' || chr(9) || 'b' END AS s FROM customer)
SELECT k, regexp_full_match(s, '[0-9]{6}') AS six, substr(regexp_replace(s, '[^0-9]', '', 'g'), 1, 6) AS digits, k % 4 <> 3 AS plain, c_mktsegment AS first,
  rtrim(regexp_replace(upper(regexp_replace(md5(c_name), '[\s-]', '', 'g')), '(.{4})', '\1-', 'g'), '-') AS code, array_to_string([c_mktsegment, 'x'], '+') AS parts,
  contains('the ' || lower(c_mktsegment) || ' customer', CASE WHEN k % 2 = 0 THEN 'building' ELSE 'customer' END) AS found FROM c""")
def input_rules(spark, sf):
    k, n = F.col("c_custkey"), F.col("c_custkey") % 4
    s = F.when(n == 0, F.lpad((k % 1_000_000).cast("string"), 6, "0")).when(n == 1, k.cast("string")).when(n == 2, F.concat(F.lit("12 34-"), k)).otherwise(F.lit("a\tb"))
    asked = F.when(k % 2 == 0, F.lit(" BUILDING the ")).otherwise(F.lit("Customer The"))
    named = F.concat(F.lit("  "), "c_mktsegment", F.lit("﻿and more"))
    return _t(spark, sf, "customer").select(
        k.alias("k"), text.six_digits(s).alias("six"), text.code_digits(s).alias("digits"), text.no_controls(s).alias("plain"), text.first_word(named).alias("first"),
        text.recovery_groups(F.md5("c_name")).alias("code"), F.array_join(text.split_list(F.concat("c_mktsegment", F.lit(",,x,"))), "+").alias("parts"),
        text.matches_words(asked, F.concat(F.lit("the "), F.lower("c_mktsegment"), F.lit(" customer"))).alias("found"),
    )


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 OR c_custkey % 5 = 1 THEN 'wrong' WHEN c_acctbal <= 0 THEN 'expired' ELSE 'ok' END AS verdict FROM customer""")
def token_verdicts(spark, sf):
    """Sealed codes: some changed, some of another user, some at their end."""
    secret, k = b"not a secret, only for this query", F.col("c_custkey")
    sealed = tokens.seal(F.to_json(F.struct("c_custkey")), F.col("c_name"), secret, "code")
    opened = tokens.open_sealed(F.when(k % 5 == 0, F.concat(sealed, F.lit("A"))).otherwise(sealed), F.col("c_name"), secret, "code")
    now = F.lit("2024-01-02").cast("timestamp")
    ends = F.when(F.col("c_acctbal") > 0, F.lit("2024-01-03")).otherwise(F.lit("2024-01-02")).cast("timestamp")
    own = F.when(k % 5 == 1, F.lit("another")).otherwise(F.col("c_name"))
    return _t(spark, sf, "customer").select("c_custkey", tokens.verdict(opened, F.col("c_name"), own, ends, now).alias("verdict"))


@query("SELECT p_partkey FROM part WHERE p_partkey % 6 IN (0, 5) AND p_size = 7")
def catalog_grades(spark, sf):
    """Parts as entries of a catalog whose grade is a number, a text, a fraction, of something nested, missing, or a number beside a nested one."""
    size = F.col("p_size").cast("string")
    forms = ['{"grade":%s}', '{"grade":"%s"}', '{"grade":%s.0}', '{"x":{"grade":%s}}', '{"size":%s}', '{"x":{"grade":"7"},"grade":%s}']
    raw = F.get(F.array(*(F.format_string(f, size) for f in forms)), (F.col("p_partkey") % 6).cast("int"))
    return files.catalog_entries(_t(spark, sf, "part").select("p_partkey", raw.alias("raw")), 7).select("p_partkey")


@query("SELECT event_id, CASE WHEN event_type IN ('error', 'signup') OR event_id % 5 = 0 THEN -1 ELSE CAST(json_extract_string(props, '$.k') AS INT) END AS k FROM events")
def stored_values(spark, sf):
    """Stored properties, or the default where they are cut off, blank or lack what is required."""
    stored = F.when(F.col("event_type") == "error", F.substring("props", 1, 4)).when(F.col("event_type") == "signup", F.lit(" ")).when(F.col("event_id") % 5 == 0, F.lit('{"other": 1}')).otherwise(F.col("props"))
    value = files.stored_value(stored, "k int", F.struct(F.lit(-1).alias("k")), ("k",))
    return _t(spark, sf, "events").select("event_id", value["k"].alias("k"))


@query("""SELECT l_orderkey AS subject_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS number, CAST(l_partkey AS VARCHAR) AS chapter_id FROM lineitem""")
def manifest_chapters(spark, sf):
    """Orders as manifests of one subject whose chapters are its items: guarded by schema and count, and flattened."""
    items = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))), lambda x: F.struct(
        x["l_partkey"].cast("string").alias("chapterId"), x["l_suppkey"].cast("string").alias("bookId"), x["l_linenumber"].cast("int").alias("number"), F.lit("").alias("title"), F.lit("").alias("summary")))
    orders = _t(spark, sf, "lineitem").groupBy("l_orderkey").agg(items.alias("chapters"))
    subject = F.struct(F.col("l_orderkey").cast("string").alias("subjectId"), F.lit("").alias("name"), F.lit("").alias("icon"), F.size("chapters").alias("chapterCount"), "chapters")
    rows = orders.select(F.lit("v1").alias("schema"), F.lit("cbse").alias("board"), F.lit("1").alias("profileVersion"), F.lit(7).alias("class"), F.array(subject).alias("subjects"))
    flat = files.flattened(files.guarded(rows, "v1"))
    return flat.select(F.col("subject_id").cast("long").alias("subject_id"), "number", "chapter_id")


@query("SELECT l_orderkey, l_linenumber, 'e-' || o_custkey AS etag FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def required_files(spark, sf):
    """Items' orders as files that must be there, with their ETags."""
    wanted = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_orderkey").cast("string").alias("name"))
    there = _t(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("name"), F.concat(F.lit("e-"), "o_custkey").alias("etag"))
    return files.required(wanted, there).select("l_orderkey", "l_linenumber", "etag")


@query("""SELECT event_id, CASE WHEN event_id % 5 > 3 OR event_type NOT IN ('view', 'click') THEN 'parked' ELSE event_type END AS handler FROM events
WHERE NOT (event_type IN ('view', 'click') AND event_id % 5 <= 3 AND event_id % 11 = 0)""")
def dispatched(spark, sf):
    """Events as deliveries of two kinds of actions, handled once though they come twice; too often failed and unknown kinds are parked, unreadable ones fail."""
    k = F.col("event_id")
    rows = _t(spark, sf, "events").select("event_id", F.col("event_type").alias("routing_key"), F.when(k % 11 != 0, "{}").alias("body"), F.array(F.struct((k % 5).cast("int").alias("count"))).alias("x_death"))
    out = scratch(spark)

    def put(name):
        return lambda df: df.select("event_id", F.lit(name).alias("handler")).write.mode("append").parquet(out)

    handle = actions.dispatch({"view": put("view"), "click": put("click")}, put("parked"), F.col("body").isNotNull(), 3)
    run = actions.handle_once(scratch(spark), ["event_id"], handle)
    for batch in range(2):
        run(rows.where((k % 3 < 2) if batch == 0 else (k % 3 > 0)), batch)
    return spark.read.parquet(out)


@query("SELECT min(event_id) AS event_id, user_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events WHERE user_id * 100 + CAST(json_extract_string(props, '$.k') AS INT) NOT IN (SELECT c_custkey FROM customer) GROUP BY ALL")
def inserted_once(spark, sf):
    """Events insert a key of user and number unless a customer has it; the first of each key does."""
    k = F.get_json_object("props", "$.k").cast("int")
    rows = _t(spark, sf, "events").select("event_id", "user_id", k.alias("k")).withColumn("key", F.col("user_id") * 100 + F.col("k"))
    there = _t(spark, sf, "customer").select(F.col("c_custkey").alias("key"))
    return records.insert_new(there, rows, ["key"], "event_id").select("event_id", "user_id", "k")


@query("""SELECT l_orderkey, count(*) AS rows FROM lineitem l WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey, l_partkey HAVING count(*) > 1)
  AND l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_partkey IN (SELECT s_suppkey FROM supplier)) GROUP BY l_orderkey""")
def inserted_together(spark, sf):
    """Orders insert the parts of their items in one write each: none where a part is there, or comes twice in it."""
    rows = _t(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    there = _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_partkey"))
    return records.insert_together(there, rows, ["l_partkey"], "l_orderkey").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("rows"))
