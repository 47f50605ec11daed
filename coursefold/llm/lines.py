"""Operator 3: near-duplicate lines by a deletion-neighbourhood join.

A line is its words, in lower case for A-Z. Of equal lines, of any length, the earliest stays. Two lines of five
words or more are near, too, if one word changed, added or removed makes them equal. A near pair shares the
words left or right of that place, so only lines that share half their words with another line go on.
Those emit each variant with one word deleted, as a hashed key. Lines with equal variants at one
place, and a line equal to another's variant, are near; the earliest of them stands for its group, so
groups are only aggregated. The word edit distance of each claimed pair is then verified.

Distinct lines are numbered in the order of their places, so that one long stands for a line and its place.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import boxed, materialize, own_name, table, tidy, unboxed

_LAST = (1 << 63) - 1
POSITION = ["d", "t", "i"]
LINES = "d long, t long, i int, l1 long, l2 long, k1 long, k2 long, k3 long, k4 long"
#: Bytes of lines handled at once in a task.
_AT_ONCE = 1 << 20


def _words(line: bytes) -> list[bytes]:
    return line.lower().split()


def _halves(words: list[bytes]) -> list[int]:
    """Keys of the first and last half, as this line or as one with a word more."""
    import xxhash

    out = []
    for n in (len(words), len(words) - 1):
        half = n // 2
        out.append(xxhash.xxh64_intdigest(b" ".join(words[:half]), 4 * n))
        out.append(xxhash.xxh64_intdigest(b" ".join(words[len(words) - half :]), 4 * n + 1))
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    """d, t, text: the document's place in the order (null ids last) and its text's hash."""
    body = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("d"), F.xxhash64(body).alias("t"), body.cast("binary").alias("body"))


def _read(batches) -> Iterator[list[tuple]]:
    """(d, t, i, words) of the lines with words, some ``_AT_ONCE`` bytes of text in a list."""
    rows, size = [], 0
    for b in batches:
        for d, t, body in zip(*b.columns):
            d, t = d.as_py(), t.as_py()
            for i, line in enumerate(body.as_py().split(b"\n")):
                if words := _words(line):
                    rows.append((d, t, i, words))
                    size += len(line)
                    if size >= _AT_ONCE:
                        yield rows
                        rows, size = [], 0
    if rows:
        yield rows


def long_lines(docs: DataFrame, least: int) -> DataFrame:
    """Lines with words: place, 128-bit name, and from ``least`` words on half keys."""

    def run(batches):
        import struct

        import pyarrow as pa
        import xxhash

        for some in _read(batches):
            rows = []
            for d, t, i, words in some:
                keys = [k - (k >> 63 << 64) for k in _halves(words)] if len(words) >= least else [None] * 4
                rows.append((d, t, i, *struct.unpack("<qq", xxhash.xxh3_128_digest(b" ".join(words))), *keys))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 2 else pa.int64()) for k, c in enumerate(zip(*rows))], names=["d", "t", "i", "l1", "l2", "k1", "k2", "k3", "k4"])

    return _keyed(docs).mapInArrow(tidy(run), LINES)


def _line_texts(docs: DataFrame, places: DataFrame) -> DataFrame:
    """id, line (its words, joined by spaces) of the lines at ``places`` (id, d, t, i)."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for body, which in zip(b.column(0), b.column(1)):
                lines, which = body.as_py().split(b"\n"), which.as_py()
                yield pa.RecordBatch.from_arrays([pa.array([w["id"] for w in which], pa.int64()), pa.array([b" ".join(_words(lines[w["i"]])) for w in which], pa.binary())], names=["id", "line"])

    wanted = places.groupBy("d", "t").agg(F.collect_list(F.struct("id", "i")).alias("which"))
    found = _keyed(docs).join(wanted, ["d", "t"]).select("body", "which").mapInArrow(tidy(run), "id long, line binary")
    return found.groupBy("id").agg(F.first("line").alias("line"))  # repeated rows give a line twice


def _variants(lines: DataFrame) -> DataFrame:
    """id, v (hash), j: each line without its word j, and with j = -1 the whole line to compare with those."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        base = np.uint64(0x9E3779B97F4A7C15)
        up = np.ones(1, np.uint64)

        def out():
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(np.concatenate(vs).view(np.int64)), pa.array(np.concatenate(js).astype(np.int32))], names=["id", "v", "j"])

        ids, vs, js, n = [], [], [], []
        for b in batches:
            for id_, line in zip(*b.columns):
                h = np.array(list(map(xxhash.xxh64_intdigest, line.as_py().split(b" "))), np.uint64)
                if len(h) > len(up):
                    up = np.full(2 * len(h), base)
                    up[0] = 1
                    up = np.multiply.accumulate(up)
                total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)], dtype=np.uint64)))
                ids.append(id_.as_py())
                vs.append(np.append(total[:-1] * base + (total[-1] - total[1:]), total[-1:] * base))
                js.append(np.append(np.arange(len(h)), -1))
                n.append(len(h) + 1)
                if n[-1] > 1 << 16 or len(n) >= 1 << 12:
                    yield out()
                    ids, vs, js, n = [], [], [], []
        if n:
            yield out()

    return lines.select("id", "line").mapInArrow(tidy(run), "id long, v long, j int")


def within_one_word(a: bytes | None, b: bytes | None) -> bool:
    """Whether the word edit distance of two lines is at most 1: common words at both ends leave one at most."""
    x, y = (a or b"").split(), (b or b"").split()
    if abs(len(x) - len(y)) > 1:
        return False
    most, n = max(len(x), len(y)), min(len(x), len(y))
    head = next((k for k in range(n) if x[k] != y[k]), n)
    tail = next((k for k in range(n - head) if x[-1 - k] != y[-1 - k]), n - head)
    return head + tail >= most - 1


def _verified(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """The ids of those pairs (id, e) whose lines are within one word."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            keep = [within_one_word(x.as_py(), y.as_py()) for x, y in zip(b.column(1), b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep, pa.bool_()))], names=["id"])

    both = pairs.join(lines.toDF("id", "a"), "id").join(lines.toDF("e", "b"), "e")
    return both.select("id", "a", "b").mapInArrow(tidy(run), "id long").distinct()


def near_earlier(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """The ids of those ``distinct`` lines that have an earlier line within one word."""
    keys = distinct.where("k1 is not null").select("id", F.explode(F.array("k1", "k2", "k3", "k4")).alias("k"))  # the four differ by their seeds
    shared = keys.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sharing = keys.join(shared, "k", "left_semi").select("id").distinct()
    lines = materialize(_line_texts(docs, distinct.select("id", *POSITION).join(sharing, "id", "left_semi")))
    variants = materialize(_variants(lines))
    changed = variants.where("j >= 0").groupBy("v", "j").agg(F.min("id").alias("e"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    added = variants.groupBy("v").agg(F.min(F.when(F.col("j") < 0, F.col("id"))).alias("whole"), F.min(F.when(F.col("j") >= 0, F.col("id"))).alias("longer")).where("whole is not null and longer is not null")
    claims = variants.join(changed, ["v", "j"]).select("id", "e")
    claims = claims.unionByName(variants.join(added, "v").select("id", F.when(F.col("j") < 0, F.col("longer")).otherwise(F.col("whole")).alias("e")))
    return _verified(claims.where("e < id").distinct(), lines)


def kept_lines(docs: DataFrame, least: int = 5) -> DataFrame:
    """d, t and the numbers of the lines with words that stay, for each document that keeps any."""
    keys = ["k1", "k2", "k3", "k4"]
    first = F.min(F.struct(*POSITION)).alias("place")
    distinct = long_lines(docs, least).groupBy("l1", "l2").agg(first, *(F.min(k).alias(k) for k in keys)).select("place.*", *keys)
    numbered = distinct.repartitionByRange(*POSITION).sortWithinPartitions(*POSITION).select(F.monotonically_increasing_id().alias("id"), *POSITION, *keys)
    distinct = materialize(numbered)
    return distinct.select("id", *POSITION).join(near_earlier(docs, distinct), "id", "left_anti").groupBy("d", "t").agg(F.collect_list("i").alias("stay"))


def dedup_lines(docs: DataFrame, least: int = 5) -> DataFrame:
    """All rows and columns of ``docs``, with the kept lines as ``text``, and n_lines and n_dropped.

    A line with words goes if an equal one stands earlier, in the order of doc_id (null last) and line, and a line
    of at least ``least`` words also if a near one of so many does; whether that one goes itself does not matter.
    Near is a word edit distance of 1: a similarity of 0.8 or more for lines of 5 words, of 0.98 for 50. Longer lines that
    differ in more words are left to the operators on documents. Lines without words stay. A null text stays null and has no lines. Repeated rows with one id are one document
    to the order, so they keep the same lines. Long texts are handled a MB of lines at a time. Columns of ``docs``
    keep their values whatever their names; if it has an n_lines or n_dropped itself, the new one has ``_``
    before its name. An empty table gives no rows.
    """
    stay = materialize(kept_lines(docs, least))
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(boxed(docs).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("d"), F.xxhash64(body).alias("t"))
    rows = rows.join(stay, ["d", "t"], "left").select("row", "stay", F.split(F.col("row.text"), "\n").alias("lines"))
    at = F.sequence(F.lit(0), F.size("lines") - 1)
    blank = F.filter(at, lambda i: F.btrim(F.get("lines", i), F.lit(" \t\n\r\x0b\x0c")) == "")
    none = F.array().cast("array<int>")
    rows = rows.select("row", "lines", F.when(F.col("lines").isNotNull(), F.sort_array(F.array_union(F.coalesce("stay", none), blank))).alias("left"))
    n_lines, n_left = (F.coalesce(F.size(F.coalesce(c, none.cast(t))).cast("long"), F.lit(0)) for c, t in (("lines", "array<string>"), ("left", "array<int>")))
    kept = F.array_join(F.transform("left", lambda i: F.get("lines", i)), "\n")
    text = F.when(n_lines == n_left, F.col("row.text")).otherwise(kept)
    # rows of a generator: a later filter on them is not pushed below, where it would split the text again for every line
    rows = rows.select("row", F.inline(F.array(F.struct(text.alias("text"), n_lines.alias("n_lines"), (n_lines - n_left).alias("n_dropped")))))
    return rows.select(*unboxed(docs, text=F.col("text")), F.col("n_lines").alias(own_name(docs, "n_lines")), F.col("n_dropped").alias(own_name(docs, "n_dropped")))


def op3_deletion_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM s),
w AS (
  SELECT doc_id, i, line, list_filter(regexp_split_to_array(
    translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM u),
e AS (SELECT ws, min((doc_id, i)) AS place FROM w WHERE len(ws) > 0 GROUP BY ws),
d AS (SELECT * FROM e WHERE len(ws) >= 5),
v AS (
  SELECT place, ws, unnest(range(1, len(ws) + 1)) AS j FROM d),
x AS (SELECT place, j, list_concat(ws[1:j - 1], ws[j + 1:]) AS without FROM v),
changed AS (SELECT without, j, min(place) AS e FROM x GROUP BY without, j HAVING count(*) > 1),
gone AS (
  SELECT x.place FROM x JOIN changed c ON x.without = c.without AND x.j = c.j WHERE c.e < x.place
  UNION SELECT d.place FROM d JOIN x ON x.without = d.ws WHERE x.place < d.place
  UNION SELECT x.place FROM d JOIN x ON x.without = d.ws WHERE d.place < x.place),
k AS (
  SELECT w.doc_id, w.i, w.line, len(w.ws) = 0 OR (e.place IS NOT NULL AND g.place IS NULL) AS stays
  FROM w LEFT JOIN e ON e.place = (w.doc_id, w.i) LEFT JOIN gone g ON g.place = (w.doc_id, w.i))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT stays) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE stays), '')) AS kept_sha256
FROM k GROUP BY doc_id
UNION ALL SELECT doc_id, 0, 0, sha256('') FROM documents WHERE text IS NULL
"""
