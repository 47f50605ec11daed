"""Operator 2: stupid-backoff scores of documents under the n-gram counts of the corpus.

The relation of exploded n-grams is kept in columns: a block of documents sends to each bucket of hashes
its distinct n-grams, sorted, with their counts in the block. A bucket adds up what it gets into its part
of the count table and answers each block with the totals, in the order sent; that is the join. Blocks
then score their documents from the totals alone. However frequent an n-gram is, a block sends it once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, pieces, table

ORDERS = (1, 2, 3)
COUNTS = "block long, n int, bucket int, hashes binary, counts binary"


def _pack(values) -> bytes:
    """Integers as zstd of their byte planes: sorted hashes come as differences, whose high bytes agree."""
    import numpy as np
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes())


def _unpack(data: bytes, kind: str):
    import numpy as np
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(kind)


class Words:
    """64-bit hashes of words, remembered up to ``limit`` of them."""

    def __init__(self, limit: int = 500_000):
        self.known: dict[bytes, int] = {}
        self.limit = limit

    def of(self, text: bytes):
        import numpy as np
        import xxhash

        known, out = self.known, [np.zeros(0, np.uint64)]
        for piece in pieces(text):
            words = piece.lower().split()
            if len(known) > self.limit:
                known.clear()
            for w in set(words).difference(known):
                known[w] = xxhash.xxh64_intdigest(w)
            out.append(np.array(list(map(known.__getitem__, words)), np.uint64))
        return np.concatenate(out)


def ngrams(words: list):
    """For each order the hashes of all documents' n-grams, end to end; a document of m words has m - n + 1."""
    import numpy as np

    out = []
    for n in ORDERS:
        parts = []
        for w in words:
            if len(w) < n:
                continue
            h = w[: len(w) - n + 1] * np.uint64(0x9E3779B97F4A7C15)
            for k in range(1, n):
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + w[k : len(w) - n + 1 + k]
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
            parts.append(h ^ (h >> np.uint64(31)))
        out.append(np.concatenate(parts) if parts else np.zeros(0, np.uint64))
    return out


def _blocks(batches, block_words: int):
    """(block number, [(doc_id, text, word hashes)]) of a task's documents, in their order."""
    from pyspark import TaskContext

    number, held, size, words = TaskContext.get().partitionId() << 20, [], 0, Words()
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            text = text or b""
            held.append((doc_id, text, w := words.of(text)))
            size += len(w)
            if size >= block_words:
                yield number, held
                number, held, size = number + 1, [], 0
    if held:
        yield number, held


def score_documents(docs: DataFrame, backoff: float = 0.4, min_count: int = 2, block_words: int = 1 << 20, chunk_bytes: int = 1 << 20, stable: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words and log10_score, the sum of its words' log10 scores.

    Words are split at white space, A-Z in lower case. A word scores count(n-gram) / count(its context),
    with n = 3 or as much as stands before it, if the n-gram occurs ``min_count`` times in the corpus;
    else ``backoff`` times the score with a word less of context, and at last its share of all words.
    All n-grams of all texts count, the scored text's own, too. One that occurs once does so only at the very place that is
    scored, so by default it has not been seen and backs off; with a ``min_count`` of 1 no word would ever back off.
    Null and empty texts have no words and score 0; repeated rows count and score once each; a null id
    is kept. Further columns are ignored; long texts are split a MB at a time. An empty table gives no rows.

    Documents are read twice and must come in the same order, as from files; else leave ``stable`` false
    and they are written to the shared folder first.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    if not stable:
        narrow = materialize(narrow)
    buckets = max(64, 8 * narrow.rdd.getNumPartitions())

    def explode(batches):
        import numpy as np
        import pyarrow as pa

        for block, held in _blocks(batches, block_words):
            rows = []
            for n, all_ in zip(ORDERS, ngrams([w for _, _, w in held])):
                hashes, counts = np.unique(all_, return_counts=True)
                # buckets are ranges of the hash, so their parts end to end are sorted
                bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
                cuts = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
                for b in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
                    part = slice(cuts[b], cuts[b + 1])
                    rows.append((block, n, b, _pack(np.diff(hashes[part], prepend=np.uint64(0))), _pack(counts[part].astype(np.uint32))))
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["block", "n", "bucket", "hashes", "counts"])

    def answer(pdf):
        import numpy as np
        import pandas as pd

        hashes = [np.cumsum(_unpack(h, "<u8"), dtype=np.uint64) for h in pdf.hashes]
        counts = [_unpack(c, "<u4") for c in pdf.counts]
        every, place = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(place, np.concatenate(counts), len(every)).astype(np.uint64)[place]
        ends = np.cumsum([len(h) for h in hashes])
        back = [_pack(np.ascontiguousarray(t)) for t in np.split(total, ends[:-1])]
        return pd.DataFrame({"block": pdf.block, "n": pdf.n, "bucket": pdf.bucket, "totals": back})

    def texts(batches):
        import numpy as np
        import pyarrow as pa
        import zstandard

        z = zstandard.ZstdCompressor(level=3)

        def chunk(docs):  # texts compressed together take a tenth less room
            about = np.array([[d or 0 for d, _ in docs], [len(t) for _, t in docs], [d is None for d, _ in docs]], np.int64)
            return _pack(about.reshape(-1)), z.compress(b"".join(t for _, t in docs))

        for block, held in _blocks(batches, block_words):
            rows, part, size = [], [], 0
            for doc_id, text, _ in held:
                part.append((doc_id, text))
                size += len(text)
                if size >= chunk_bytes:
                    rows.append(chunk(part))
                    part, size = [], 0
            if part:
                rows.append(chunk(part))
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(rows), pa.int64()), pa.array(range(len(rows)), pa.int32()), pa.array([a for a, _ in rows], pa.binary()), pa.array([t for _, t in rows], pa.binary())], names=["block", "at", "about", "texts"])

    def score(own, totals):
        import numpy as np
        import pandas as pd
        import zstandard

        z, words = zstandard.ZstdDecompressor(), Words()
        ids, hashed = [], []
        for about, packed in own.sort_values("at")[["about", "texts"]].itertuples(index=False):
            joined, end = z.decompress(packed), 0
            for doc_id, size, null in _unpack(about, "<i8").reshape(3, -1).T.tolist():
                ids.append(None if null else doc_id)
                hashed.append(words.of(joined[end : end + size]))
                end += size
        totals = totals.sort_values(["n", "bucket"])
        count = []
        for n, all_ in zip(ORDERS, ngrams(hashed)):
            parts = [_unpack(t, "<u8") for t in totals.totals[totals.n == n]]
            count.append(np.concatenate(parts).astype(float)[np.unique(all_, return_inverse=True)[1]] if parts else np.zeros(0))
        at, rows = [0] * len(ORDERS), []
        for doc_id, w in zip(ids, hashed):
            m, c = len(w), []
            for k, n in enumerate(ORDERS):
                size = max(0, m - n + 1)
                c.append(count[k][at[k] : at[k] + size])
                at[k] += size
            value = np.log10(c[0])  # less log10 of all words, which is taken off at the end
            shares = np.ones(m)
            for k in range(1, len(ORDERS)):
                seen = c[k] >= min_count
                value[k:] = np.where(seen, np.log10(c[k] / c[k - 1][: max(0, m - k)]), value[k:] + np.log10(backoff))
                shares[k:] = np.where(seen, 0, shares[k:])
            rows.append((doc_id, m, float(value.sum()), int(shares.sum())))
        out = pd.DataFrame(rows, columns=["doc_id", "n_words", "partial", "shares"], dtype=object)
        return out.astype({"doc_id": "Int64", "n_words": "int64", "partial": "float64", "shares": "int64"})

    sent = narrow.mapInArrow(explode, COUNTS)
    # written apart from what follows, so that the counts that were sent are freed before texts are
    totals = materialize(sent.groupBy("n", "bucket").applyInPandas(answer, "block long, n int, bucket int, totals binary"))
    blocks = narrow.mapInArrow(texts, "block long, at int, about binary, texts binary")
    scored = materialize(blocks.groupBy("block").cogroup(totals.groupBy("block")).applyInPandas(score, "doc_id long, n_words long, partial double, shares long"))
    size = scored.agg(F.sum("n_words")).first()[0] or 1
    return scored.select("doc_id", "n_words", (F.col("partial") - F.col("shares") * F.log10(F.lit(float(size)))).alias("log10_score"))


def op2_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_documents(table(spark, sf_dir, "documents"), stable=True)
    return out.withColumn("log10_score", F.round("log10_score", 4))


OP2_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
u AS (SELECT r, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS c FROM d),
w AS MATERIALIZED (SELECT r, i, c, lag(c) OVER o AS b, lag(c, 2) OVER o AS a FROM u WINDOW o AS (PARTITION BY r ORDER BY i)),
c1 AS (SELECT c, count(*) AS n FROM w GROUP BY c),
c2 AS (SELECT b, c, count(*) AS n FROM w WHERE b IS NOT NULL GROUP BY b, c),
c3 AS (SELECT a, b, c, count(*) AS n FROM w WHERE a IS NOT NULL GROUP BY a, b, c),
s AS (
  SELECT w.r, CASE
    WHEN c3.n >= 2 THEN log10(c3.n / x2.n)
    WHEN c2.n >= 2 THEN log10(c2.n / x1.n) + CASE WHEN w.a IS NULL THEN 0 ELSE log10(0.4) END
    ELSE log10(c1.n / (SELECT count(*) FROM w)) + CASE WHEN w.b IS NULL THEN 0 WHEN w.a IS NULL THEN log10(0.4) ELSE 2 * log10(0.4) END END AS v
  FROM w JOIN c1 ON c1.c = w.c LEFT JOIN c2 ON c2.b = w.b AND c2.c = w.c LEFT JOIN c3 ON c3.a = w.a AND c3.b = w.b AND c3.c = w.c
    LEFT JOIN c1 x1 ON x1.c = w.b LEFT JOIN c2 x2 ON x2.b = w.a AND x2.c = w.b)
SELECT d.doc_id, any_value(len(d.ws)) AS n_words, round(coalesce(sum(s.v), 0), 4) AS log10_score
FROM d LEFT JOIN s ON s.r = d.r GROUP BY d.r, d.doc_id
"""
