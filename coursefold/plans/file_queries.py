"""Slices, files and nested values applied to the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys, text
from ..operators import listing, records, slices
from ..sources.files import row_counts
from .registry import query
from .registry import table as _t


def _files(spark, sf):
    """Lineitems as chapters of their order's book: some lack a summary, some a plan, urgent orders the book's own file."""
    item = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("b"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("c"), "l_discount", "l_tax")
    name = lambda folder, end=".json": keys.path(folder, F.col("b"), F.concat(F.col("c"), F.lit(end))).alias("name")
    own = _t(spark, sf, "orders").where("o_orderpriority <> '1-URGENT'").select(keys.path("sources", F.concat(F.col("o_orderkey"), F.lit(".json"))).alias("name"))
    return records.in_one(item.select(name("refined")), item.where("l_discount < 0.1").select(name("summaries")), item.where("l_tax < 0.08").select(name("plans", ".plan.json")), own)


def _books(spark, sf):
    return _t(spark, sf, "orders").select(F.when(F.col("o_orderstatus") == "F", "cbse").otherwise("ssc").alias("board"), F.col("o_orderkey").cast("string").alias("book_id"))


def _judged(spark, sf):
    return slices.judge_books(_books(spark, sf), _files(spark, sf), required=("sources",))


_BOOKS = """
WITH i AS (SELECT l_orderkey, 'refined/' || l_orderkey || '/' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '.json' AS name, l_discount >= 0.1 AS a, l_tax >= 0.08 AS b FROM lineitem),
g AS (SELECT l_orderkey, count(*) AS files, min(name) FILTER (WHERE a) AS s, min(name) FILTER (WHERE b) AS p FROM i GROUP BY l_orderkey),
j AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 'cbse' ELSE 'ssc' END AS board, CAST(o_orderkey AS VARCHAR) AS book_id, l_orderkey IS NULL AS bare, s, p, o_orderpriority = '1-URGENT' AS u, files FROM orders LEFT JOIN g ON l_orderkey = o_orderkey),
k AS (SELECT *, CASE WHEN bare AND board = 'cbse' THEN 'skipped' WHEN bare OR s IS NOT NULL OR p IS NOT NULL OR u THEN 'broken' ELSE 'ready' END AS state FROM j)
"""


@query(_BOOKS + """SELECT board, book_id, state, CASE WHEN state = 'broken' THEN CASE WHEN bare THEN 'unbuilt' WHEN s IS NOT NULL THEN 'no-summary' WHEN p IS NOT NULL THEN 'no-plan' ELSE 'no-sources' END END AS fault,
  CASE WHEN state = 'broken' THEN CASE WHEN bare THEN 'refined/' || book_id WHEN s IS NOT NULL THEN s WHEN p IS NOT NULL THEN p ELSE 'sources/' || book_id || '.json' END END AS first FROM k""")
def books_judged(spark, sf):
    return _judged(spark, sf)


@query(_BOOKS + "SELECT board, sum(3 * files)::BIGINT + 2 AS files, count(*) AS books FROM k WHERE state = 'ready' GROUP BY board")
def slice_sizes(spark, sf):
    sound = _judged(spark, sf).where("state <> 'broken'")
    return slices.slice_counts(slices.slice_files(sound, _files(spark, sf)), "board")


@query("SELECT 'd/' || doc_id || '.txt' AS name, n_chars AS size FROM documents UNION ALL SELECT 'p/' || page_id || '.html', length(html) FROM pages UNION ALL SELECT 'b/' || item_id || '.txt', length(text) FROM benchmark")
def files_union(spark, sf):
    one = lambda table, folder, key, end, size: _t(spark, sf, table).select(keys.path(folder, F.concat(F.col(key), F.lit(end))).alias("name"), size.cast("long").alias("size"))
    return slices.disjoint_union(one("documents", "d", "doc_id", ".txt", F.col("n_chars")), one("pages", "p", "page_id", ".html", F.length("html")), one("benchmark", "b", "item_id", ".txt", F.length("text")))


@query("""SELECT coalesce(c_custkey, s_suppkey * 17) AS id, coalesce(s_nationkey, c_nationkey) AS nation, CASE WHEN s_suppkey IS NULL THEN c_mktsegment WHEN s_suppkey % 2 = 0 THEN coalesce(c_mktsegment, 'NEW') ELSE 'NEW' END AS kind,
  s_suppkey IS NOT NULL AND (c_custkey IS NULL OR s_nationkey <> c_nationkey OR s_suppkey % 2 = 1) AS changed FROM customer FULL JOIN supplier ON s_suppkey * 17 = c_custkey""")
def manifest_upsert(spark, sf):
    manifest = _t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("kind"))
    rows = _t(spark, sf, "supplier").select((F.col("s_suppkey") * 17).alias("id"), F.col("s_nationkey").alias("nation"), "s_suppkey")
    entries = rows.join(manifest.select("id", "kind"), "id", "left").select("id", "nation", F.when(F.col("s_suppkey") % 2 == 0, F.coalesce("kind", F.lit("NEW"))).otherwise("NEW").alias("kind"))
    return slices.upsert(manifest, entries, ["id"])


def _slice_names(spark, sf):
    """Orders' items as files of the customer's slice; a slice is marked ready if one of its orders is urgent."""
    o = _t(spark, sf, "orders")
    item = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_suppkey").join(o.select("o_orderkey", "o_custkey"), "o_orderkey")
    names = item.select(keys.path("f", F.col("o_custkey"), F.concat_ws("-", "o_orderkey", "l_linenumber", "l_partkey", "l_suppkey")).alias("name"))
    marks = o.where("o_orderpriority = '1-URGENT'").select("o_custkey").distinct().select(keys.path("f", F.col("o_custkey"), "version.json").alias("name"))
    return records.in_one(names, marks)


_NAMES = """
WITH n AS (SELECT 'f/' || o_custkey || '/' || o_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS name, o_custkey AS c FROM lineitem JOIN orders ON o_orderkey = l_orderkey
  UNION ALL SELECT DISTINCT 'f/' || o_custkey || '/version.json', o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
"""


@query(_NAMES + "SELECT name FROM n WHERE c IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def ready_files(spark, sf):
    return slices.ready_only(_slice_names(spark, sf), F.regexp_extract("name", "^f/[^/]*/", 0))


@query(_NAMES + "SELECT replace(name, 'f/1/', 'copy/of/1/') AS name FROM n WHERE c = 1")
def copied_files(spark, sf):
    return slices.copied(_slice_names(spark, sf), "f/1/", F.lit("copy/of/1/"))


@query(_NAMES + "SELECT name FROM n WHERE c <> 1")
def prefix_removed(spark, sf):
    return slices.without_prefix(_slice_names(spark, sf), "f/1/")


@query("""SELECT 'orders' AS "table", count(*) AS rows FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'documents', count(*) FROM documents""")
def table_counts(spark, sf):
    return row_counts({name: _t(spark, sf, name) for name in ("orders", "lineitem", "events", "documents")})


@query("""SELECT l_orderkey, min_by(l_partkey, (l_linenumber, l_partkey, l_suppkey)) AS l_partkey FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey""")
def first_failing(spark, sf):
    rows = _t(spark, sf, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_partkey", F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("place"))
    return records.first_per_group(rows, ["l_orderkey"], "place").select("l_orderkey", "l_partkey")


@query("SELECT user_id, string_agg(DISTINCT event_type, ' | ' ORDER BY event_type) AS line FROM events GROUP BY user_id")
def queue_lines(spark, sf):
    return listing.value_line(_t(spark, sf, "events"), "user_id", "event_type")  # of five types


@query("""SELECT 'order' AS kind, o_orderkey AS id, o_orderstatus AS state, NULL::BIGINT AS part FROM orders UNION ALL SELECT 'item', l_orderkey, NULL, l_partkey FROM lineitem UNION ALL SELECT 'customer', c_custkey, NULL, NULL FROM customer""")
def row_kinds(spark, sf):
    o = _t(spark, sf, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("state"))
    i = _t(spark, sf, "lineitem").select(F.lit("item").alias("kind"), F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("part"))
    return records.in_one(o, i, _t(spark, sf, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id")))


@query("""SELECT event_id, '{"a":{"x":2,"y":' || event_id || '},"k":' || json_extract_string(props, '$.k') || '}' AS canonical, true AS same, event_id % 2 = 0 AS as_wanted FROM events""")
def canonical_json(spark, sf):
    """Two texts of one value with keys and blanks apart, and a third that differs for odd ids."""
    k, n = F.get_json_object("props", "$.k"), F.col("event_id").cast("string")
    a = F.concat(F.lit('{"k": '), k, F.lit(', "a": {"y": '), n, F.lit(', "x": 2}}'))
    b = F.concat(F.lit('{"a":{"x":2,"y":'), n, F.lit('},"k":'), k, F.lit("}"))
    c = F.concat(F.lit('{"a":{"x":2,"y":'), n, F.lit('},"k":'), F.when(F.col("event_id") % 2 == 0, k).otherwise("-1"), F.lit("}"))
    form = lambda x: text.canonical_json(x)
    return _t(spark, sf, "events").select("event_id", form(a).alias("canonical"), (form(a) == form(b)).alias("same"), (form(a) == form(c)).alias("as_wanted"))


@query("""SELECT c_custkey, '{"c_name":"' || c_name || '","balance":' || CASE WHEN c_acctbal > 0 THEN CAST(c_nationkey AS VARCHAR) ELSE 'null' END || ',"delay":' || c_custkey || '}' AS doc FROM customer""")
def compact_documents(spark, sf):
    doc = text.compact_json(F.struct("c_name", F.when(F.col("c_acctbal") > 0, F.col("c_nationkey")).alias("balance"), F.lit("{{delay}}").alias("delay")))
    return _t(spark, sf, "customer").select("c_custkey", text.substituted(doc, {"delay": F.col("c_custkey")}).alias("doc"))


@query("""WITH g AS (SELECT l_orderkey, list({'id': 'p' || l_partkey, 'name': CASE WHEN l_discount < 0.1 THEN l_returnflag ELSE ' ' END} ORDER BY l_linenumber, l_partkey, l_suppkey) AS x FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, CASE WHEN len(x) >= 3 AND len(list_filter(x, lambda c: trim(c.name) = '')) = 0 THEN array_to_string(list_transform(x, lambda c: c.id), ',')
  ELSE array_to_string(list_transform(range(1, 6), lambda n: l_orderkey || '-c' || n), ',') END AS concepts FROM g""")
def concepts_or_made(spark, sf):
    found = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "name"))), lambda x: F.struct(F.concat(F.lit("p"), x["l_partkey"]).alias("id"), x["name"].alias("name")))
    items = _t(spark, sf, "lineitem").withColumn("name", F.when(F.col("l_discount") < 0.1, F.col("l_returnflag")).otherwise(" "))
    rows = items.groupBy("l_orderkey").agg(found.alias("found"))
    concepts = text.concepts_or(F.col("found"), F.col("l_orderkey").cast("string"))
    return rows.select("l_orderkey", F.array_join(F.transform(concepts, lambda c: c["id"]), ",").alias("concepts"))


@query("SELECT l_orderkey, round(max(l_quantity * 0.73 + l_tax * 0.73), 6) AS length, count(*) AS steps FROM lineitem GROUP BY l_orderkey")
def timeline_lengths(spark, sf):
    steps = F.collect_list(F.struct(F.col("l_linenumber").alias("part"), F.col("l_quantity").alias("delay"), F.col("l_tax").alias("duration")))
    rows = _t(spark, sf, "lineitem").groupBy("l_orderkey").agg(text.scaled(steps, F.lit(0.73)).alias("s"))
    return rows.select("l_orderkey", F.round(text.timeline_length(F.col("s")), 6).alias("length"), F.size("s").cast("long").alias("steps"))


@query("""WITH g AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS a, list(l_partkey ORDER BY l_partkey) AS b FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, a = b AS same, CAST(to_json(list_transform(a, lambda p: {'part': p})) AS VARCHAR) AS heads FROM g""")
def nested_heads(spark, sf):
    """Orders' items cut down to their part, and whether they come in the order of parts."""
    items = F.sort_array(F.collect_list(F.struct("l_linenumber", F.col("l_partkey").alias("part"), "l_suppkey", "l_tax")))
    rows = _t(spark, sf, "lineitem").groupBy("l_orderkey").agg(items.alias("items"))
    parts = F.transform("items", lambda x: x["part"])
    return rows.select("l_orderkey", text.same_list(parts, F.sort_array(parts)).alias("same"), text.compact_json(text.headers(F.col("items"), "part")).alias("heads"))
