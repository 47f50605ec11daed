"""Tenants, ledger and lookups applied to the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, tokens
from ..operators import records, tenants
from .registry import query
from .registry import table as _t


def child_events(spark, sf):
    """Events as the life of children: a user is a family with up to eight of them."""
    k = F.get_json_object("props", "$.k").cast("int")
    event = F.when(F.col("event_type") == "signup", "added").when(F.col("event_type") == "error", "deleting").when(F.col("event_type") == "purchase", "removed")
    e = _t(spark, sf, "events").select(F.col("user_id").alias("family_id"), (k % 8).alias("child_id"), F.col("event_id").alias("seq"), event.alias("event"), F.col("event_id").alias("position"), (k % 10 + 1).alias("class_level"))
    return e.where("event is not null")


_CHILDREN = """
WITH e AS (SELECT user_id AS family_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, event_id AS seq, event_type FROM events),
r AS (SELECT family_id, k % 8 AS child_id, max(seq) FILTER (WHERE event_type = 'purchase') AS ended FROM e GROUP BY ALL),
a AS (SELECT e.family_id, e.k % 8 AS child_id, min(seq) FILTER (WHERE event_type = 'signup') AS position, max(seq) FILTER (WHERE event_type = 'error') AS gone
  FROM e JOIN r ON r.family_id = e.family_id AND r.child_id = e.k % 8 WHERE seq > coalesce(ended, -1) GROUP BY ALL),
c AS (SELECT a.family_id, child_id, position, k % 10 + 1 AS class_level, CASE WHEN gone > position THEN 'deleting' ELSE 'active' END AS status FROM a JOIN e ON e.seq = a.position)
"""


@query(_CHILDREN + "SELECT family_id, child_id, position, class_level, status FROM c")
def child_lifecycle(spark, sf):
    return tenants.lifecycle(child_events(spark, sf), ["family_id", "child_id"])


@query(_CHILDREN + "SELECT family_id, string_agg(child_id, ',' ORDER BY position) AS children FROM c WHERE status = 'active' GROUP BY family_id")
def children_in_place(spark, sf):
    rows = tenants.lifecycle(child_events(spark, sf), ["family_id", "child_id"])
    return tenants.in_place(rows, "family_id", "position", "child_id").select("family_id", F.array_join(F.transform("children", lambda x: x.cast("string")), ",").alias("children"))


@query(_CHILDREN + """, v AS (SELECT user_id + 5 AS family_id, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type = 'view'),
h AS (SELECT family_id, count(*) FILTER (WHERE status = 'active') AS held, max(position) AS top FROM c GROUP BY family_id),
j AS (SELECT seq, v.family_id, n, top, CASE WHEN v.family_id NOT IN (SELECT user_id FROM events) THEN 'family-not-found' WHEN coalesce(held, 0) + n > 6 THEN 'child-limit-reached' END AS reason FROM v LEFT JOIN h USING (family_id))
SELECT seq, family_id, reason, CASE WHEN reason IS NULL THEN coalesce(top, -1) + n END AS position FROM j""")
def admit_children(spark, sf):
    e = _t(spark, sf, "events")
    adds = e.where("event_type = 'view'").select((F.col("user_id") + 5).alias("family_id"), F.col("event_id").alias("seq"))
    rows = tenants.lifecycle(child_events(spark, sf), ["family_id", "child_id"])
    return tenants.admit(adds, rows, e.select(F.col("user_id").alias("family_id")), "family_id")


def _callers(spark, sf):
    return _t(spark, sf, "customer").where("c_mktsegment <> 'MACHINERY'").select(F.col("c_custkey").alias("caller"), F.col("c_nationkey").alias("tenant"))


@query("SELECT o_custkey AS caller, l_orderkey, l_linenumber, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderpriority <> '5-LOW'")
def scoped_rows(spark, sf):
    """Items of the orders that are a caller's; some orders are nobody's."""
    callers = _t(spark, sf, "orders").where("o_orderpriority <> '5-LOW'").select(F.col("o_custkey").alias("caller"), F.col("o_orderkey").alias("tenant"))
    items = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("tenant"), "l_orderkey", "l_linenumber", "l_partkey")
    return tenants.scoped(items, callers, "caller", "tenant").select("caller", "l_orderkey", "l_linenumber", "l_partkey")


@query("""SELECT o_orderkey, o_custkey AS caller, o_orderkey % 120 AS s_suppkey, c_custkey IS NOT NULL AND s.s_suppkey IS NOT NULL AS found,
  CASE WHEN c_custkey IS NULL THEN 'not-registered' WHEN s.s_suppkey IS NULL THEN 'not-found' END AS reason
FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_mktsegment <> 'MACHINERY' LEFT JOIN supplier s ON s.s_suppkey = o_orderkey % 120 AND s.s_nationkey = c_nationkey""")
def scoped_lookups(spark, sf):
    asked = _t(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("caller"), (F.col("o_orderkey") % 120).alias("s_suppkey"))
    suppliers = _t(spark, sf, "supplier").select(F.col("s_nationkey").alias("tenant"), "s_suppkey")
    return tenants.scoped_lookup(asked, suppliers, _callers(spark, sf), "caller", "tenant", "s_suppkey")


def _families(spark, sf):
    """Orders as memberships in fifty families, customers as profiles that point at one each, suppliers as what families own."""
    members = _t(spark, sf, "orders").select(F.col("o_custkey").alias("uid"), (F.col("o_orderkey") % 50).alias("family_id"))
    profiles = _t(spark, sf, "customer").select(F.col("c_custkey").alias("uid"), (F.col("c_custkey") % 50).alias("family_id"))
    owned = _t(spark, sf, "supplier").select("s_suppkey", (F.col("s_suppkey") % 50).alias("family_id"), "s_acctbal")
    return members, profiles, owned


@query("SELECT c_custkey AS uid, c_custkey % 50 AS family_id FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 50 = c_custkey % 50)")
def own_profiles(spark, sf):
    members, profiles, _ = _families(spark, sf)
    return tenants.own_profiles(members, profiles, "uid", "family_id")


@query("""WITH g AS (SELECT DISTINCT s_suppkey % 50 AS f FROM supplier WHERE s_acctbal < 0)
SELECT 'profiles' AS kind, c_custkey AS id FROM customer WHERE NOT (c_custkey % 50 IN (SELECT f FROM g) AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 50 = c_custkey % 50))
UNION ALL SELECT 'owned', s_suppkey FROM supplier WHERE s_suppkey % 50 NOT IN (SELECT f FROM g)
UNION ALL SELECT 'members', o_custkey FROM orders WHERE o_orderkey % 50 NOT IN (SELECT f FROM g)""")
def erase_tenants(spark, sf):
    members, profiles, owned = _families(spark, sf)
    left = tenants.erase(owned.where("s_acctbal < 0"), "family_id", "uid", members, profiles, {"owned": owned})
    ids = {"profiles": "uid", "members": "uid", "owned": "s_suppkey"}
    kinds = [left[kind].select(F.lit(kind).alias("kind"), F.col(c).alias("id")) for kind, c in ids.items()]
    return records.in_one(*kinds)


def _requests(spark, sf):
    """Sign-ups as registrations of 97 families by the users."""
    k = F.get_json_object("props", "$.k").cast("int")
    children = F.transform(F.sequence(F.lit(1), k % 3 + 1), lambda i: F.struct((i + k).alias("name"), (k % 10 + 1).alias("class_level")))
    return _t(spark, sf, "events").where("event_type = 'signup'").select(F.col("event_id").alias("seq"), F.col("user_id").alias("uid"), (F.col("event_id") * 7 % 97).alias("family_id"), children.alias("children"), k.alias("k"))


# one request after the other, with the users and families so far
_REGISTER = """
WITH RECURSIVE q AS (SELECT event_id AS seq, user_id AS uid, event_id * 7 % 97 AS family_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, row_number() OVER (ORDER BY event_id) AS n FROM events WHERE event_type = 'signup'),
s AS (
  SELECT 0::BIGINT AS n, []::BIGINT[] AS us, []::BIGINT[] AS fs, '' AS result
  UNION ALL
  SELECT q.n, CASE WHEN won THEN list_append(us, uid) ELSE us END, CASE WHEN won THEN list_append(fs, family_id) ELSE fs END, CASE WHEN won THEN 'registered' WHEN list_contains(us, uid) THEN 'already-registered' ELSE 'family-id-taken' END
  FROM (SELECT q.n, us, fs, uid, family_id, NOT list_contains(us, uid) AND NOT list_contains(fs, family_id) AS won FROM s JOIN q ON q.n = s.n + 1) q),
r AS (SELECT seq, uid, family_id, k, result FROM q JOIN s USING (n))
"""


@query(_REGISTER + "SELECT seq, uid, family_id, result FROM r")
def register_families(spark, sf):
    return tenants.register(_requests(spark, sf)).select("seq", "uid", "family_id", "result")


@query(_REGISTER + ", w AS (SELECT *, unnest(range(0, k % 3 + 1)) AS position FROM r WHERE result = 'registered') SELECT family_id, position, position + 1 + k AS name, k % 10 + 1 AS class_level, 'active' AS status FROM w")
def registered_children(spark, sf):
    return tenants.registered_rows(tenants.register(_requests(spark, sf)), "children")


@query("SELECT o_orderkey, o_custkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment <> 'BUILDING'")
def still_active(spark, sf):
    rows = _t(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_mktsegment") == "BUILDING", "deleting").otherwise("active").alias("status"))
    return tenants.still_active(_t(spark, sf, "orders").select("o_orderkey", "o_custkey"), rows, ["o_custkey"])


@query("""SELECT c_custkey, CASE WHEN c_nationkey > 0 THEN c_name END AS uid, CASE WHEN c_nationkey > 0 THEN coalesce(CASE WHEN c_acctbal > 0 THEN c_mktsegment END, '') END AS name,
  CASE WHEN c_nationkey > 0 THEN '' END AS email, CASE WHEN c_nationkey > 0 THEN c_nationkey % 3 = 1 END AS email_verified FROM customer""")
def callers(spark, sf):
    n = F.col("c_nationkey")
    verified = F.when(n % 3 == 1, " True").when(n % 3 == 2, "yes")
    claims = F.map_from_entries(F.filter(F.array(
        F.struct(F.lit("sub").alias("k"), F.when(n > 0, F.col("c_name")).otherwise(" ").alias("v")), F.struct(F.lit("name").alias("k"), F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("v")),
        F.struct(F.lit("email_verified").alias("k"), verified.alias("v")),
    ), lambda x: x["v"].isNotNull()))
    return _t(spark, sf, "customer").select("c_custkey", tenants.caller(claims).alias("w")).select("c_custkey", "w.uid", "w.name", "w.email", "w.email_verified")


@query("""WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day, min(ts) AS recorded_at, coalesce(max_by(ts, event_id) FILTER (WHERE event_type = 'click'), min(ts)) AS sent,
  max_by(ts, event_id) FILTER (WHERE event_type = 'purchase') AS confirmed, count(*) FILTER (WHERE event_type = 'error') AS done FROM events GROUP BY ALL),
k AS (SELECT * FROM e WHERE done = 0 OR recorded_at > TIMESTAMP '2024-01-24')
SELECT user_id, CAST(day AS VARCHAR) AS day, done = 0 AND sent <= CASE WHEN confirmed IS NULL THEN TIMESTAMP '2024-01-30 23:55:00' ELSE TIMESTAMP '2024-01-21' END AS send_again FROM k""")
def start_up_pass(spark, sf):
    from .queries import ledger_events  # the two modules name each other

    key = ["user_id", "day"]
    rows = records.fold_ledger(ledger_events(spark, sf), key)
    now = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    kept, again = records.start_up(rows, now, F.expr("INTERVAL '7' DAY"), F.expr("INTERVAL '5' MINUTE"), F.expr("INTERVAL '10' DAY"))
    again = again.select(*key, F.lit(True).alias("send_again"))
    return kept.select(*key).join(again, key, "left").select("user_id", F.col("day").cast("string"), F.coalesce("send_again", F.lit(False)).alias("send_again"))


@query("SELECT event_id, user_id, 's' || event_id % 3 AS queue, ts + INTERVAL 10 DAY <= TIMESTAMP '2024-01-31' AS due FROM events WHERE event_type = 'error'")
def returned_retries(spark, sf):
    dead = _t(spark, sf, "events").where("event_type = 'error'").select("event_id", "user_id", F.concat(F.lit("s"), F.col("event_id") % 3).alias("queue"), F.col("ts").alias("died_at"))
    due, waiting = records.returned(dead, F.lit("2024-01-31").cast("timestamp_ntz"), F.expr("INTERVAL '10' DAY"))
    return records.in_one(due.withColumn("due", F.lit(True)), waiting.withColumn("due", F.lit(False))).drop("died_at")


@query("""WITH p AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN repeat('0', 32) WHEN 2 THEN md5(CAST(event_id AS VARCHAR)) ELSE upper(md5(CAST(event_id AS VARCHAR))) END AS t FROM events),
l AS (SELECT event_id, '00-' || t || '-' || substr(t, 1, 15) || '1-01' AS parent FROM p)
SELECT event_id, CASE WHEN regexp_full_match(parent, '[0-9a-f]{2}-[0-9a-f]{32}-[0-9a-f]{16}-[0-9a-f]{2}') AND substr(parent, 4, 32) <> repeat('0', 32) AND substr(parent, 37, 16) <> repeat('0', 16) THEN parent END AS link FROM l""")
def trace_links(spark, sf):
    n = F.col("event_id")
    t = F.when(n % 4 == 1, "0" * 32).when(n % 4 == 2, F.md5(n.cast("string"))).when(n % 4 == 3, F.upper(F.md5(n.cast("string"))))
    parent = F.concat(F.lit("00-"), t, F.lit("-"), F.substring(t, 1, 15), F.lit("1-01"))
    # an upper-case digest without letters is valid, too: one in about three million
    return _t(spark, sf, "events").select("event_id", records.trace_link(parent).alias("link"))


@query("""WITH c AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'code-wrong' WHEN 1 THEN 'proof-required' WHEN 2 THEN 'code-too-soon' WHEN 3 THEN 'email-not-sent' WHEN 4 THEN 'child-not-found' WHEN 5 THEN 'code-expired' ELSE 'family-changed' END AS code FROM events)
SELECT event_id, code, CASE code WHEN 'code-wrong' THEN 'wrongCode' WHEN 'proof-required' THEN 'codeExpired' WHEN 'code-expired' THEN 'codeExpired' WHEN 'code-too-soon' THEN 'tooSoon' WHEN 'email-not-sent' THEN 'emailNotSent' ELSE 'other' END AS reason,
  CASE code WHEN 'code-wrong' THEN 400 WHEN 'proof-required' THEN 403 WHEN 'code-too-soon' THEN 429 WHEN 'email-not-sent' THEN 502 WHEN 'child-not-found' THEN 404 WHEN 'code-expired' THEN 410 ELSE 409 END AS status FROM c""")
def failure_reasons(spark, sf):
    codes = ["code-wrong", "proof-required", "code-too-soon", "email-not-sent", "child-not-found", "code-expired", "family-changed"]
    code = F.get(F.array(*map(F.lit, codes)), (F.col("event_id") % 7).cast("int"))
    rows = _t(spark, sf, "events").select("event_id", code.alias("code"))
    return rows.select("event_id", "code", text.looked_up(F.col("code"), text.REASONS, "other").alias("reason"), text.http_status(F.col("code")).alias("status"))


@query("""SELECT c_custkey, c_nationkey NOT IN (3, 5, 7, 9) AS region_ok, CASE WHEN c_nationkey IN (2, 4) THEN ' ' ELSE upper(c_name[1]) END AS initial,
  CASE WHEN c_nationkey IN (1, 3) THEN 0 WHEN c_nationkey % 2 = 0 THEN NULL WHEN c_custkey % 12 + 1 > 10 THEN 2 END AS blocking, CASE WHEN c_nationkey % 2 = 0 THEN 2 ELSE 3 END AS sent, c_custkey % 9 + 2000 AS newest FROM customer""")
def form_checks(spark, sf):
    """Three drafts a form: the first may have a bad name, the second is blank where the nation is even, the third's class may be none."""
    n, k = F.col("c_nationkey"), F.col("c_custkey")
    draft = lambda name, level, year: F.struct(name.alias("name"), level.cast("int").alias("class_level"), year.alias("birth_year"), F.lit("").alias("school"))
    named, none = F.col("c_name"), F.lit(None)
    year = k % 9 + 2003
    born = (year - 10).cast("string")
    first = draft(F.when(n == 3, F.lit("a\tb")).when(n == 1, F.lit("\u00a0\ufeff")).otherwise(named), F.lit(3), born)
    blank = draft(F.lit(" "), none, F.lit(""))
    second = F.when(n % 2 == 0, blank).otherwise(draft(named, F.lit(5), born))
    third = F.when(n % 2 == 0, draft(named, F.lit(1), born)).otherwise(draft(named, k % 12 + 1, born))
    drafts = F.array(first, second, third)
    blocking = text.blocking_draft(drafts, F.lit("cbse"), year).cast("int")
    # a hidden character, a lone no-break space, 62 units in 31 characters, 61 letters; 60 units in 30 are allowed
    odd = {3: "a\u200bb", 5: "\u00a0", 7: "\U0001f600" * 31, 9: "x" * 61, 11: "\U0001f600" * 30}
    shown = F.col("c_mktsegment")
    for nation, said in odd.items():
        shown = F.when(n == nation, F.lit(said)).otherwise(shown)
    region = text.valid_region(shown)
    initial = text.initial(F.when(n.isin(2, 4), F.concat(F.lit(" "), named)).otherwise(named))
    return _t(spark, sf, "customer").select(k, region.alias("region_ok"), initial.alias("initial"), blocking.alias("blocking"), F.size(text.first_and_touched(drafts)).alias("sent"), F.get(text.birth_years(year), 0).alias("newest"))


@query("""SELECT c_custkey, c_nationkey % 4 = 0 AND c_acctbal > 0 AS ok FROM customer""")
def proofs(spark, sf):
    """Sealed proofs, some for another operation or user, some expired, some not opened at all."""
    secret = b"not a secret, only for this query"
    n, who = F.col("c_nationkey"), F.col("c_name")
    claim = F.to_json(F.struct(
        F.when(n % 4 == 1, "another").otherwise(who).alias("uidHash"), F.when(n % 4 == 2, "read").otherwise("erase").alias("operation"), F.col("c_custkey").cast("string").alias("target"),
        F.when(F.col("c_acctbal") > 0, "2024-01-02T00:00:00Z").otherwise("2024-01-01T00:00:00Z").alias("expiresAt"),
    ))
    sealed = F.when(n % 4 == 3, F.lit("no.seal")).otherwise(tokens.seal(claim, F.lit(""), secret, "proof"))
    rows = _t(spark, sf, "customer").select("c_custkey", who, tokens.open_sealed(sealed, F.lit(""), secret, "proof").alias("opened"))
    now = F.lit("2024-01-01T00:00:00Z").cast("timestamp")
    return rows.select("c_custkey", tokens.proven(F.col("opened"), who, F.lit("erase"), F.col("c_custkey").cast("string"), now).alias("ok"))
