"""Operator 12: vectors as short codes, by Lloyd's rounds that compare only what has moved.

Vectors are cut into parts, and each part position has a codebook of integer entries. Each row keeps, for every
part, its entry and its exact squared distance. After the entries have been replaced by the means of their parts, a
part whose own entry stayed where it was can only do better with an entry that moved: those alone are compared against
the distance that it keeps. Parts whose own entry moved rescan their codebook. Equal distances go to the lower index.
All of it is integer arithmetic; sums travel as limbs of 30 bits and so never overflow.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

LIMB = 30
MOST = (1 << 63) - 1
SUMS = "slot int, at int, limb int, value long"


def usable(vectors: DataFrame, *extra: str) -> DataFrame:
    """(vec_id, ``extra``, embedding as doubles) of the rows that take part.

    Left out are vectors that are null, empty, hold a null or non-finite component or are not as long as most.
    Rows with a null vec_id stay, as do repeated ones: each is a row of its own.
    """
    x = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), *extra, F.col("embedding").cast("array<double>").alias("embedding")).where(F.size("embedding") > 0)
    odd = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    x = x.where(~F.exists("embedding", odd))
    sizes = x.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1)
    return x.join(F.broadcast(sizes), F.size("embedding") == F.col("d"), "left_semi")


def integers(x, scale: int = 256):
    """floor(scale * x) of rows of doubles, as int64 or, where they are too large for that, as Python integers."""
    import math

    import numpy as np

    if np.abs(x).max(initial=0) < 2.0**40:
        return np.floor(x * float(scale)).astype(np.int64)
    one = lambda v: int(v) * scale if abs(v) >= 2.0**60 else math.floor(v * scale)
    return np.array([[one(v) for v in row] for row in x.tolist()], object).reshape(x.shape)


def _largest(x) -> int:
    return max((abs(int(v)) for v in (x.min(), x.max())), default=0) if x.size else 0


def distances(x, entries):
    """Exact squared distances (rows x entries): in doubles or int64 where these are exact, else in Python integers."""
    import numpy as np

    bound = x.shape[1] * (_largest(x) + _largest(entries)) ** 2
    if bound < 1 << 53:
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a**2).sum(1)[:, None] - 2 * (a @ b.T) + (b**2).sum(1)).astype(np.int64)
    kind = np.int64 if bound < 1 << 63 else object
    return ((x.astype(kind)[:, None, :] - entries.astype(kind)) ** 2).sum(2)


def nearest(x, entries, code=None, near=None, moved=None):
    """(index, distance) of each row's nearest entry.

    With ``code`` and ``near`` from before and the entries that ``moved`` since, rows on an entry that did not move meet
    the moved ones only. A distance of -1 is one too large to have been kept: its row rescans.
    """
    import numpy as np

    if code is None:
        far = distances(x, entries)
        code = far.argmin(1)
        return code, far[np.arange(len(x)), code]
    code, near = code.astype(np.int64), near.astype(object) if x.dtype == object or entries.dtype == object else near.copy()
    again = moved[code] | (near < 0).astype(bool)
    if again.any():
        code[again], near[again] = nearest(x[again], entries)
    fixed, active = np.flatnonzero(~again), np.flatnonzero(moved)
    if len(fixed) and len(active):
        to, d = nearest(x[fixed], entries[active])
        to = active[to]
        better = ((d < near[fixed]) | ((d == near[fixed]) & (to < code[fixed]))).astype(bool)
        code[fixed[better]], near[fixed[better]] = to[better], d[better]
    return code, near


@dataclass
class Lloyd:
    """Codebooks, one (entries x width) for each part, and which of their entries moved in the last round."""

    cuts: list[int]
    books: list
    moved: list | None = None

    def assign(self, x, codes=None, near=None):
        """(codes, distances) of rows of integers: rows x parts."""
        import numpy as np

        out = []
        for p, (a, b) in enumerate(zip(self.cuts, self.cuts[1:])):
            before = () if codes is None else (codes[:, p], near[:, p], self.moved[p])
            out.append(nearest(x[:, a:b], self.books[p], *before))
        return np.stack([c for c, _ in out], 1), np.stack([d.astype(object) if any(e.dtype == object for _, e in out) else d for _, d in out], 1)

    def means(self, totals: dict[tuple[int, int], int]) -> Lloyd:
        """The books with each used entry replaced by its parts' floor(sum / count); ``totals`` by (slot, position or -1 for the count)."""
        import numpy as np

        books, moved = [], []
        for p, (a, b) in enumerate(zip(self.cuts, self.cuts[1:])):
            new = self.books[p].astype(object)
            for e in range(len(new)):
                slot = p * len(new) + e
                if n := totals.get((slot, -1), 0):
                    new[e] = [totals.get((slot, j), 0) // n for j in range(b - a)]
            moved.append((new != self.books[p]).any(1).astype(bool))
            books.append(new if _largest(new) >= 1 << 62 else new.astype(np.int64))
        return Lloyd(self.cuts, books, moved)

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(v) for book in self.books for v in book.reshape(-1).tolist()).encode()).hexdigest()


def _by_size(x):
    """Rows of doubles in groups (row numbers, integers): those with large components apart, so that few pay for them."""
    import numpy as np

    large = (np.abs(x) >= 2.0**14).any(1)
    return [(at, integers(x[at])) for at in (np.flatnonzero(~large), np.flatnonzero(large)) if len(at)]


def _rows(batch):
    import numpy as np

    return np.asarray(batch.column("embedding").flatten(), np.float64).reshape(batch.num_rows, -1)


def _lists(batch, name, kind):
    import numpy as np

    return np.frombuffer(b"".join(batch.column(name).to_pylist()), kind).reshape(batch.num_rows, -1)


def _assigned(rows: DataFrame, lloyd: Lloyd, first: bool, last: bool) -> DataFrame:
    """Rows with ``codes`` (a byte for each part) and ``near`` (64-bit distances), and with ``last`` their sum as ``error`` in place of it."""
    shared = rows.sparkSession.sparkContext.broadcast(lloyd)
    kept = [c for c in rows.columns if c not in ("codes", "near") and not (last and c == "embedding")]
    schema = rows.select(*kept).schema.add("codes", "binary")
    schema = schema.add("error", "long") if last else schema.add("near", "binary")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            x, parts = _rows(batch), len(shared.value.books)
            codes, near = np.zeros((len(x), parts), np.uint8), np.zeros((len(x), parts), np.int64)
            error = np.zeros(len(x), np.int64)
            before = () if first else (_lists(batch, "codes", np.uint8), _lists(batch, "near", np.int64))
            for at, some in _by_size(x):
                codes[at], d = shared.value.assign(some, *(b[at] for b in before))
                fits = d.dtype != object and d.max(initial=0) < 1 << 55
                error[at] = d.sum(1) if fits else [min(MOST, sum(map(int, r))) for r in d]
                near[at] = d if fits else np.where(d.astype(object) <= MOST, d, -1).astype(np.int64)
            second = pa.array(error) if last else pa.array([r.tobytes() for r in near], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array([c.tobytes() for c in codes], pa.binary()), second], schema=_arrow(batch, kept, last))

    return rows.mapInArrow(run, schema)


def _arrow(batch, kept, last):
    import pyarrow as pa

    fields = [batch.schema.field(c) for c in kept]
    return pa.schema([*fields, pa.field("codes", pa.binary()), pa.field("error", pa.int64()) if last else pa.field("near", pa.binary())])


def _totals(rows: DataFrame, cuts: list[int], entries: int) -> dict[tuple[int, int], int]:
    """Counts and sums of the parts of each entry. Each task sends one row for each number; what reaches the driver is as large as the codebooks."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        sums = np.zeros((entries, cuts[-1]), object)
        counts = np.zeros((entries, len(cuts) - 1), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = _lists(batch, "codes", np.uint8)
            for at, x in _by_size(_rows(batch)):
                small = len(at) * _largest(x) < 1 << 53
                for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    code = codes[at, p]
                    counts[:, p] += np.bincount(code, minlength=entries)
                    for j in range(a, b):
                        if small:
                            sums[:, j] += np.bincount(code, x[:, j].astype(np.float64), entries).astype(np.int64)
                        else:
                            np.add.at(sums[:, j], code, x[:, j].astype(object))
        out = []
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            for e in np.flatnonzero(counts[:, p]).tolist():
                numbers = [(-1, int(counts[e, p])), *((j - a, int(sums[e, j])) for j in range(a, b))]
                for at, v in numbers:
                    left, sign, limb = abs(v), 1 if v >= 0 else -1, 0
                    while left:
                        out.append((p * entries + e, at, limb, sign * (left & ((1 << LIMB) - 1))))
                        left, limb = left >> LIMB, limb + 1
        cols = list(zip(*out)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["slot", "at", "limb", "value"])

    found: dict[tuple[int, int], int] = {}
    for slot, at, limb, value in rows.select("embedding", "codes").mapInArrow(run, SUMS).groupBy("slot", "at", "limb").agg(F.sum("value")).collect():
        found[slot, at] = found.get((slot, at), 0) + (value << (LIMB * limb))
    return found


def compress(vectors: DataFrame, *extra: str, parts: int = 16, entries: int = 64, rounds: int = 2) -> tuple[DataFrame, Lloyd]:
    """(rows: vec_id, ``extra``, codes, error; the final codebooks).

    Codebooks start as the parts of the ``entries`` least vec_ids (nulls last; of one id, lesser vectors first), fewer where
    the table has fewer; an entry that no part is on stays as it is. ``codes`` has a byte for each part, ``error`` the squared
    distances in all, at most 2**63 - 1. Of lengths that ``parts`` does not divide, some parts are one longer. See ``usable`` for
    rows that take no part; an empty table gives no rows and no codebooks. Columns not named are ignored.
    """
    import numpy as np

    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte: 1 to 256 entries")
    x = materialize(usable(vectors, *extra))
    seeds = x.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").collect()
    if not seeds:
        return x.drop("embedding").withColumns({"codes": F.lit(None).cast("binary"), "error": F.lit(0).cast("long")}), Lloyd([0], [])
    start = integers(np.array([r[0] for r in seeds], np.float64))
    cuts = [start.shape[1] * p // parts for p in range(parts + 1)]
    lloyd, rows = Lloyd(cuts, [start[:, a:b] for a, b in zip(cuts, cuts[1:])]), x
    for k in range(rounds):
        rows = materialize(_assigned(rows, lloyd, first=k == 0, last=False))
        lloyd = lloyd.means(_totals(rows, cuts, len(seeds)))
    return materialize(_assigned(rows, lloyd, first=rounds == 0, last=True)), lloyd


def by_label(rows: DataFrame, label: str, most: int = 100_000) -> DataFrame:
    """``rows`` with ``label_error``, the error summed over equal labels, nulls together.

    Up to ``most`` labels are sent to all tasks, more are joined, where Spark splits a label with very many rows.
    """
    sums = materialize(rows.groupBy(F.col(label).alias("_label")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long").alias("label_error")))
    sums = F.broadcast(sums) if sums.count() <= most else sums.hint("merge")
    return rows.join(sums, F.col(label).eqNullSafe(F.col("_label"))).drop("_label")


def hexadecimal(codes: Column) -> Column:
    return F.lower(F.hex(codes))


def op12_active_entry_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, lloyd = compress(table(spark, sf_dir, "embeddings"), "label")
    return by_label(rows, "label").select("vec_id", hexadecimal(F.col("codes")).alias("code"), "error", "label_error", F.lit(lloyd.digest()).alias("codebooks_sha256"))


def _round(k: int) -> str:
    """SQL of one assignment ``a<k>`` under the books ``b<k>``, and of the books after it, ``b<k+1>``."""
    return f"""
a{k} AS MATERIALIZED (
  SELECT r, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
    SELECT x.r, x.p, b.e, sum((x.v - b.v) * (x.v - b.v)) AS d FROM x JOIN b{k} b ON b.p = x.p AND b.j = x.j GROUP BY x.r, x.p, b.e)
  GROUP BY r, p),
b{k + 1} AS MATERIALIZED (
  SELECT b.p, b.e, b.j, coalesce(m.v, b.v) AS v FROM b{k} b LEFT JOIN (
    SELECT p, e, j, (s - ((s % n) + n) % n) // n AS v FROM (
      SELECT x.p, a.e, x.j, sum(x.v)::HUGEINT AS s, count(*)::HUGEINT AS n FROM x JOIN a{k} a ON a.r = x.r AND a.p = x.p GROUP BY x.p, a.e, x.j)) m
  ON m.p = b.p AND m.e = b.e AND m.j = b.j)"""


OP12_SQL = f"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS r, vec_id, label, embedding AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (
  SELECT r, (i * 16) // n AS p, i % (n // 16) AS j, v FROM (
    SELECT r, len(v) AS n, unnest(range(len(v))) AS i, unnest(list_transform(v, lambda c: floor(256 * c::DOUBLE)::HUGEINT)) AS v FROM k)),
b0 AS (SELECT p, r AS e, j, v FROM x WHERE r < 64),{_round(0)},{_round(1)},{_round(2)},
o AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY r)
SELECT k.vec_id, o.code, o.error, sum(o.error) OVER (PARTITION BY k.label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY p, e, j)) FROM b2) AS codebooks_sha256
FROM k JOIN o ON o.r = k.r
"""
