"""Operator 4: nearest neighbours by additive quantisation.

A vector is a sum of one full-dimensional codeword from each codebook, chosen by beam search. The
index holds each vector's codes and its sum's squared norm. A query makes one table of inner products
with all codewords and scores all rows by adding up table entries and the stored norm. The best of all rows, one
shortlist for each query, are then joined with their vectors and ranked by exact distance. Shortlists of tasks are
merged a few at a time, and the more rows there are, the longer they are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

INDEX = "vec_id long, codes binary, norm float"
SHORT = "task long, query_id long, vec_id long, near float"


def kmeans(x, k: int, rounds: int, rng):
    """At most ``k`` centres (rows) of ``x``."""
    import numpy as np

    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=len(centres))
        centres[n > 0] = total[n > 0] / n[n > 0, None]
    return centres


def encode(x, books, beam: int = 8):
    """Codes (rows x codebooks) of ``x``: the best of ``beam`` partial sums after each codebook."""
    import numpy as np

    n = len(x)
    left = x[:, None, :]  # what each kept partial sum still lacks
    codes = np.zeros((n, 1, 0), np.uint8)
    for book in books:
        width = left.shape[1]
        cost = (left**2).sum(2)[:, :, None] - 2 * left @ book.T + (book**2).sum(1)
        flat = cost.reshape(n, width * len(book))
        keep = min(beam, flat.shape[1])
        best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
        row, word = best // len(book), best % len(book)
        at = np.arange(n)[:, None]
        left = left[at, row] - book[word]
        codes = np.concatenate((codes[at, row], word[:, :, None].astype(np.uint8)), axis=2)
    return codes[np.arange(n), (left**2).sum(2).argmin(1)]


def decode(codes, books):
    return sum(book[codes[:, m]] for m, book in enumerate(books))


def train(sample, codebooks: int = 24, words: int = 256, rounds: int = 8, refits: int = 2, sweeps: int = 8, ridge: float = 0.5, seed: int = 7):
    """Codebooks fitted to residuals in turn, then together by least squares on the codes, a book at a time in several ``sweeps``.

    A book's words are means of what the other books leave of their rows, drawn by ``ridge`` to what they were. That takes no more room
    than the sample, and words of few rows stay nearer to what they were, which is better for rows that are not in the sample.
    """
    import numpy as np

    rng = np.random.default_rng(seed)
    left, books = sample.copy(), []
    for _ in range(codebooks):
        books.append(kmeans(left, words, rounds, rng))
        left = left - books[-1][((books[-1] ** 2).sum(1) - 2 * left @ books[-1].T).argmin(1)]
    for _ in range(refits):
        codes = np.concatenate([encode(sample[i : i + 512], books) for i in range(0, len(sample), 512)])
        left = sample - decode(codes, books)
        for _ in range(sweeps):
            for m, book in enumerate(books):
                left += book[codes[:, m]]
                total = ridge * book
                np.add.at(total, codes[:, m], left)
                books[m] = (total / (ridge + np.bincount(codes[:, m], minlength=len(book)))[:, None]).astype(np.float32)
                left -= books[m][codes[:, m]]
    return books


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles) of rows that take part, one for each vec_id.

    Left out are null ids and vectors that are null, zero, hold a null or non-finite component or are
    not as long as most. Of several vectors with one id the least counts.
    """
    x = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null")
    odd = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    x = x.where(~F.exists("embedding", odd)).where(F.exists("embedding", lambda v: v != 0))
    sizes = x.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1)
    x = x.join(F.broadcast(sizes), F.size("embedding") == F.col("d"), "left_semi")
    return x.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


@dataclass
class Index:
    """Codes and norms of all vectors, the vectors themselves, and the codebooks."""

    codes: DataFrame
    vectors: DataFrame
    books: Broadcast
    rows: int


def sampled(x: DataFrame, rows: int, of: int):
    """At most ``rows`` vectors of ``x``, those of the least hash of vec_id, as a matrix of single floats.

    Tasks only send rows under a share of all hashes that leaves few more than are wanted: no task sorts or gets more.
    """
    import numpy as np

    # five deviations above the mean: fewer than wanted are left once in millions of tables, and then they do as well
    most = (1 << 63) - 1
    cut = min(most, most * (rows + 5 * math.isqrt(rows) + 50) // max(of, 1))
    h = F.shiftrightunsigned(F.xxhash64("vec_id"), 1)
    some = x.select(h.alias("h"), "vec_id", "embedding").where(F.col("h") <= F.lit(cut)).toArrow()
    order = np.lexsort((some.column("vec_id").to_numpy(), some.column("h").to_numpy()))[:rows]
    return _matrix(some.column("embedding"))[order].astype(np.float32)


def build_index(vectors: DataFrame, sample_rows: int = 16_384, codebooks: int = 24, words: int = 256, beam: int = 8) -> Index:
    """The index of all usable rows; codebooks are fitted to the ``sample_rows`` least by a hash of vec_id.

    An empty table makes an empty index; columns other than vec_id and embedding are ignored. Equal vectors get equal codes.
    """
    import numpy as np

    x = materialize(usable(vectors))
    size = x.count()
    sample = sampled(x, sample_rows, size)
    books = train(sample, codebooks, min(words, 256)) if len(sample) else []
    shared = x.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        books = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            v = np.asarray(batch.column(1).flatten(), np.float64).reshape(batch.num_rows, -1).astype(np.float32)
            codes = np.concatenate([encode(v[i : i + 512], books, beam) for i in range(0, len(v), 512)])
            norm = (decode(codes, books) ** 2).sum(1).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norm)], names=["vec_id", "codes", "norm"])

    return Index(materialize(x.mapInArrow(run, INDEX)), x, shared, size)


def _matrix(column):
    """A column of lists of one length as rows of doubles."""
    import numpy as np

    if not len(column):
        return np.zeros((0, 0))
    return np.asarray(column.combine_chunks().flatten(), np.float64).reshape(len(column), -1)


class Shortlists:
    """Each query's ``most`` rows of least estimated distance so far; equal estimates go to smaller ids."""

    def __init__(self, ids, queries, books, most: int):
        import numpy as np

        self.ids, self.queries, self.books, self.most = ids, queries, books, most
        self.near = np.full((len(ids), most), np.inf, np.float32)
        self.rows = np.full((len(ids), most), np.iinfo(np.int64).max)

    def add(self, vec_ids, codes, norm, at_once: int = 128) -> None:
        import numpy as np

        order = np.argsort(vec_ids, kind="stable")
        vec_ids, codes, norm = vec_ids[order], codes[order], norm[order]
        for a in range(0, len(self.ids), at_once):
            q = self.queries[a : a + at_once]
            near = np.zeros((len(q), len(vec_ids)), np.float32)
            for m, book in enumerate(self.books):
                near += (q @ book.T)[:, codes[:, m]]
            near = norm - 2 * near
            for i, s in enumerate(near, a):
                some = np.flatnonzero(s <= self.near[i, -1])
                if len(some) > self.most + 1:  # one more than wanted: the query's own row goes
                    edge = np.partition(s[some], self.most)[self.most]
                    under = some[s[some] < edge]
                    some = np.concatenate((under, some[s[some] == edge][: self.most + 1 - len(under)]))
                some = some[vec_ids[some] != self.ids[i]]
                near_i, rows_i = np.append(self.near[i], s[some]), np.append(self.rows[i], vec_ids[some])
                first = np.lexsort((rows_i, near_i))[: self.most]
                self.near[i], self.rows[i] = near_i[first], rows_i[first]


def shortlist_rows(rows: int) -> int:
    """Rows of a shortlist: the root of all rows, and 256 at least. README has the recall that it was chosen by."""
    return max(256, math.ceil(math.sqrt(rows)))


def merged(short: DataFrame, tasks: int, most: int, at_once: int = 16) -> DataFrame:
    """(query_id, vec_id) of each query's ``most`` best rows of all ``tasks``' shortlists.

    Those of ``at_once`` tasks are merged at a time, level by level, so that no task holds more of a query than so many shortlists.
    """
    while True:
        tasks = -(-tasks // at_once)
        short = short.withColumn("task", F.floor(F.col("task") / at_once))
        best = Window.partitionBy("query_id", "task").orderBy("near", "vec_id")
        short = short.withColumn("n", F.row_number().over(best)).where(F.col("n") <= most).drop("n")
        if tasks <= 1:
            return short.select("query_id", "vec_id")


def search(index: Index, queries: DataFrame, k: int = 10, shortlist: int | None = None, query_rows: int = 8192, block_rows: int = 4096, task_rows: int = 1 << 22) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest rows of the index but its own vec_id.

    Queries (vec_id, embedding) are sent to the codes in blocks of ``query_rows``, one after the other. A task scores up to ``task_rows`` codes, or as
    many more as its input has, and returns one shortlist a query; the best ``shortlist`` (see ``shortlist_rows``) of all tasks are measured exactly.
    Ties go to smaller ids, in the shortlist as in the result. No queries or an empty index: no rows.
    """
    spark = index.codes.sparkSession
    shortlist = shortlist or shortlist_rows(index.rows)
    asked = materialize(queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")))
    blocks, books, parts = max(1, -(-asked.count() // query_rows)), index.books, []
    # few large tasks send few shortlists, but all cores should have one
    tasks = max(spark.sparkContext.defaultParallelism, -(-index.rows // task_rows))
    codes = index.codes.coalesce(tasks)
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toArrow()
        shared = spark.sparkContext.broadcast((rows.column(0).to_numpy(), _matrix(rows.column(1)).astype("f4")))

        def run(batches, shared=shared):
            import numpy as np
            import pyarrow as pa
            from pyspark import TaskContext

            ids, asked = shared.value
            best = Shortlists(ids, asked, books.value, shortlist)
            for batch in batches:
                for at in range(0, batch.num_rows if len(ids) else 0, block_rows):
                    part = batch.slice(at, block_rows)
                    codes = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(part.num_rows, -1)
                    best.add(np.asarray(part.column(0)), codes, np.asarray(part.column(2)))
            real = np.isfinite(best.near)
            size, task = int(real.sum()), TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(size, task)), pa.array(np.repeat(ids, real.sum(1))), pa.array(best.rows[real]), pa.array(best.near[real])], names=["task", "query_id", "vec_id", "near"])

        parts.append(materialize(merged(codes.mapInArrow(run, SHORT), tasks, shortlist)))
        shared.destroy()  # one block at a time takes memory
    short = reduce(DataFrame.unionByName, parts)
    both = short.join(index.vectors.hint("merge"), "vec_id").join(asked.hint("merge"), "query_id")
    score = F.sqrt(F.aggregate(F.zip_with("embedding", "q", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    first = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = both.select("query_id", "vec_id", score.alias("score")).withColumn("rank", F.row_number().over(first))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build_index(table(spark, sf_dir, "embeddings"))
    return search(index, index.vectors.where("vec_id % 100 = 0"))


#: Exact search: on tables of up to 256 other vectors the shortlist holds all of them, and larger ones show the recall.
OP4_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE vec_id IS NOT NULL),
u AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
d AS (SELECT q.vec_id AS query_id, u.vec_id, sqrt(list_sum(list_transform(list_zip(u.e, q.e), lambda x: (x[1] - x[2]) * (x[1] - x[2])))) AS score FROM u q JOIN u ON u.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INT) AS rank, vec_id, score FROM d QUALIFY rank <= 10
"""
