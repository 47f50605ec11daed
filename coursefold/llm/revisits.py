"""Operator 9: resolving not-modified revisit records of a web archive.

A revisit stands for the latest earlier full response of its canonical URL, if the validators agree.
The as-of join is a window over narrow rows, in two levels: within spans of time, and over one row for
each span that has a response. However long one URL was captured, a window holds one span of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

#: Header fields of a 304 response that never replace the stored ones.
KEPT_FIELDS = ["connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade"]


def canonical_url(url: Column) -> Column:
    """The URL without scheme, fragment, ``www.``, its scheme's own port and slashes at the end of the path, its host in lower case."""
    url = F.regexp_replace(url, "#.*$", "")
    scheme = F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    rest = F.regexp_replace(url, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, "^[^/?]*", 0)), "^www[.]", "")
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "/+$", "")
    return F.concat(host, path, F.regexp_extract(rest, "[?].*$", 0))


def resolve_revisits(records: DataFrame, span: int = 100_000) -> DataFrame:
    """One row per revisit: record_id, url_key, ts, status, refers_to and the merged headers.

    ``records``: record_id, url, ts (long), kind (``response`` or ``revisit``), etag, last_modified and
    headers (a map with lower-case names). ``refers_to`` is the latest response with an earlier ts, of
    several the one with the greatest record_id. Status is ``resolved``; ``no_earlier``, also for a null
    URL or ts; or ``mismatch`` if ETags differ (weakly compared), or without both ETags the
    modification times, or neither can be compared. A resolved revisit's headers replace the stored ones
    but for ``KEPT_FIELDS``; else headers are null. Repeated revisits give a row each; of several responses with one
    record_id the greatest headers count. No records: no rows. Further columns are ignored, whatever their names.
    """
    key = canonical_url(F.col("url"))
    narrow = records.select("record_id", key.alias("url_key"), "ts", "kind", "etag", "last_modified", F.floor(F.col("ts") / span).alias("span"))
    usable = F.col("url_key").isNotNull() & F.col("ts").isNotNull()
    full = F.when(F.col("kind") == "response", F.struct("ts", "record_id", "etag", "last_modified"))
    # at one time revisits come first, as a response must be earlier
    here = Window.partitionBy("url_key", "span").orderBy("ts", F.col("kind") == "response", "record_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = narrow.where(usable).withColumn("found", F.last(full, ignorenulls=True).over(here)).where("kind = 'revisit'")
    ends = narrow.where(usable & (F.col("kind") == "response")).groupBy("url_key", "span").agg(F.max(F.struct("ts", "record_id", "etag", "last_modified")).alias("last"))
    spans = ends.unionByName(within.where("found is null").select("url_key", "span").distinct(), allowMissingColumns=True).groupBy("url_key", "span").agg(F.max("last").alias("last"))
    before = Window.partitionBy("url_key").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.withColumn("carried", F.last("last", ignorenulls=True).over(before)).where("carried is not null").select("url_key", "span", "carried")
    asof = within.join(carried, ["url_key", "span"], "left").withColumn("found", F.coalesce("found", "carried")).drop("carried", "span")
    asof = asof.unionByName(narrow.where(~usable & (F.col("kind") == "revisit")).drop("span"), allowMissingColumns=True)

    bare = lambda c: F.regexp_replace(c, "^W/", "")
    both = F.col("etag").isNotNull() & F.col("found.etag").isNotNull()
    agree = F.when(both, bare(F.col("etag")) == bare(F.col("found.etag"))).otherwise(F.coalesce(F.col("last_modified") == F.col("found.last_modified"), F.lit(False)))
    status = F.when(F.col("found").isNull(), "no_earlier").when(agree, "resolved").otherwise("mismatch")
    judged = asof.select("record_id", "url_key", "ts", status.alias("status"), F.when(status != "no_earlier", F.col("found.record_id")).alias("refers_to"))

    stored = records.where("kind = 'response'").groupBy(F.col("record_id").alias("refers_to")).agg(F.max(F.sort_array(F.map_entries("headers"))).alias("stored"))
    sent = records.where("kind = 'revisit'").groupBy("record_id").agg(F.max(F.sort_array(F.map_entries("headers"))).alias("sent"))
    out = judged.join(stored, "refers_to", "left").join(sent, "record_id", "left")
    none = F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>"))
    old, new = F.coalesce(F.map_from_entries("stored"), none), F.coalesce(F.map_from_entries("sent"), none)
    new = F.map_filter(new, lambda name, _: ~name.isin(KEPT_FIELDS))
    merged = F.map_concat(F.map_filter(old, lambda name, _: ~F.map_contains_key(new, name)), new)
    return out.select("record_id", "url_key", "ts", "status", "refers_to", F.when(F.col("status") == "resolved", merged).alias("headers"))


def captures(pages: DataFrame) -> DataFrame:
    """Archive records of ``pages``: a response for each page, and a revisit that names its content.

    Times follow page_id. A revisit comes 5 to 495 ticks after its page, or 5 before it. Some pages have a modification
    time and no ETag, some neither; some revisits name another ETag or time, a weak ETag or no URL. All follows from the rows themselves.
    """
    n = F.col("page_id")
    tick = n * 10
    later = F.when(n % 13 == 5, tick - 5).otherwise(tick + 5 + n * 7919 % 50 * 10)
    etag = F.when((n % 5 != 1) & (n % 11 != 2), F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"')))
    modified = F.when((n % 5 == 1) & (n % 11 != 2), F.concat(F.lit("day "), (F.octet_length(F.coalesce("html", F.lit(""))) % 300).cast("string")))
    sent = F.when(n % 7 == 3, F.lit('"other"')).otherwise(F.when(n % 4 == 0, F.concat(F.lit("W/"), etag)).otherwise(etag))
    since = F.when(n % 3 == 0, F.concat(modified, F.lit(" at noon"))).otherwise(modified)
    text = lambda c: c.cast("string")

    def record(id_, url, ts, kind, tag, time, **more):
        fields = {"date": text(ts), "etag": tag, "last-modified": time} | {k.replace("_", "-"): v for k, v in more.items()}
        entries = F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in fields.items()))
        headers = F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
        return F.struct(id_.alias("record_id"), url.alias("url"), ts.alias("ts"), F.lit(kind).alias("kind"), tag.alias("etag"), time.alias("last_modified"), headers.alias("headers"))

    size = text(F.octet_length(F.coalesce("html", F.lit(""))))
    response = record(n * 2, F.col("url"), tick, "response", etag, modified, content_type=F.lit("text/html"), content_length=size)
    revisit = record(n * 2 + 1, F.when(n % 17 != 3, F.col("url")), later, "revisit", sent, since, content_length=F.lit("0"), age=F.lit("0"))
    return pages.select(F.explode(F.array(response, revisit)).alias("r")).select("r.*")


def op9_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = materialize(captures(table(spark, sf_dir, "pages")))
    out = resolve_revisits(records)
    lines = F.transform(F.sort_array(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return out.withColumn("headers", F.array_join(lines, "\n"))


OP9_SQL = r"""
WITH p AS (
  SELECT page_id, regexp_replace(url, '#.*$', '') AS url, '"' || md5(coalesce(html, '')) || '"' AS tag, strlen(coalesce(html, '')) AS size FROM pages),
q AS (SELECT *, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM p),
h AS (SELECT *, regexp_replace(lower(regexp_extract(rest, '^[^/?]*', 0)), '^www[.]', '') AS host FROM q),
k AS (
  SELECT page_id, page_id * 10 AS tick, size, CASE WHEN page_id % 13 = 5 THEN page_id * 10 - 5 ELSE page_id * 10 + 5 + page_id * 7919 % 50 * 10 END AS later,
    CASE scheme WHEN 'http' THEN regexp_replace(host, ':80$', '') WHEN 'https' THEN regexp_replace(host, ':443$', '') ELSE host END
      || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') || regexp_extract(rest, '[?].*$', 0) AS url_key,
    CASE WHEN page_id % 5 <> 1 AND page_id % 11 <> 2 THEN tag END AS etag, CASE WHEN page_id % 5 = 1 AND page_id % 11 <> 2 THEN 'day ' || size % 300 END AS modified
  FROM h),
v AS (
  SELECT page_id, later, CASE WHEN page_id % 17 <> 3 THEN url_key END AS url_key, CASE WHEN page_id % 7 = 3 THEN '"other"' WHEN page_id % 4 = 0 THEN 'W/' || etag ELSE etag END AS sent,
    CASE WHEN page_id % 3 = 0 THEN modified || ' at noon' ELSE modified END AS since FROM k),
j AS (
  SELECT v.*, r.page_id AS found, r.etag, r.modified, r.size, row_number() OVER (PARTITION BY v.page_id ORDER BY r.tick DESC) AS n
  FROM v LEFT JOIN k r ON v.url_key = r.url_key AND r.tick < v.later),
s AS (
  SELECT *, CASE WHEN found IS NULL THEN 'no_earlier' WHEN sent IS NOT NULL AND etag IS NOT NULL THEN CASE WHEN replace(sent, 'W/', '') = etag THEN 'resolved' ELSE 'mismatch' END
    WHEN since = modified THEN 'resolved' ELSE 'mismatch' END AS status FROM j WHERE n = 1)
SELECT page_id * 2 + 1 AS record_id, url_key, later AS ts, status, found * 2 AS refers_to,
  CASE WHEN status = 'resolved' THEN concat_ws(chr(10), 'age: 0', 'content-length: ' || size, 'content-type: text/html', 'date: ' || later, 'etag: ' || coalesce(sent, etag), 'last-modified: ' || coalesce(since, modified)) END AS headers
FROM s
"""
