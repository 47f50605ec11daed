"""Operator 5: benchmark decontamination with an FM-index for each training shard.

A shard is a bounded stretch of a task's documents. Its text is a sequence of word numbers in which only
runs of benchmark words long enough for a phrase are kept: no phrase can occur elsewhere. The shard's
suffixes are sorted, the Burrows-Wheeler transform goes into a wavelet matrix, and all phrases are
searched backwards together, one array operation for each word and level. Occurrences are located
by walking to sampled suffix positions, and their spans are merged for each document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import repeat

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import boxed, materialize, pieces, table, tidy

#: Lower-cases A-Z and puts a space for each byte that is not in a word.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes | None) -> Iterator[bytes]:
    """Words of a text: digits, letters and all that is not ASCII. Null has none. Taken a MB of text at a time."""
    for piece in pieces((text or b"").translate(_WORD_BYTES)):
        yield from piece.split()


class Phrases:
    """A block of the benchmark: numbers (from 1) of its words, its windows as rows of numbers, and their items.

    Rows are padded with 0 at the left. Window i's items are ``owners[starts[i]:starts[i + 1]]``, which number ``names``.
    """

    def __init__(self, items: list[tuple[str | None, bytes | None]], width: int):
        import numpy as np

        self.vocabulary: dict[bytes, int] = {}
        windows: dict[bytes, list[int]] = {}
        self.names = [name for name, _ in items]
        for n, (_, text) in enumerate(items):
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)], "<i4")
            for i in range(max(1, len(ids) - width + 1) if len(ids) else 0):
                windows.setdefault(ids[i : i + width].tobytes().rjust(4 * width, b"\0"), []).append(n)
        self.patterns = np.frombuffer(b"".join(windows), "<i4").reshape(-1, width)
        self.lengths = (self.patterns > 0).sum(axis=1)
        self.starts = np.cumsum([0, *map(len, windows.values())])
        self.owners = np.array([n for own in windows.values() for n in own], np.int32)


class WaveletMatrix:
    """Rank of symbols in a sequence: for each bit from the top, the bits' running counts."""

    def __init__(self, symbols, bits: int):
        import numpy as np

        self.levels = []
        for b in reversed(range(bits)):
            ones = (symbols >> b) & 1
            count = np.concatenate(([0], np.cumsum(ones))).astype(np.int32)
            zeros = len(symbols) - int(count[-1])
            self.levels.append((b, count, zeros))
            symbols = np.concatenate((symbols[ones == 0], symbols[ones == 1]))

    def rank(self, symbol, upto):
        """How often each ``symbol`` occurs before each position ``upto``."""
        import numpy as np

        start, end = np.zeros_like(upto), upto
        for b, count, zeros in self.levels:
            one = ((symbol >> b) & 1).astype(bool)
            start = np.where(one, zeros + count[start], start - count[start])
            end = np.where(one, zeros + count[end], end - count[end])
        return end - start


class FMIndex:
    """Over numbers from 1; each run ends in a 0, and no match crosses one."""

    def __init__(self, runs, sample: int = 8):
        import numpy as np

        ends = np.flatnonzero(runs == 0)
        # each end is a symbol of its own, so all suffixes differ within their run
        keys = runs.astype(np.int64) + len(ends)
        keys[ends] = np.arange(len(ends))
        n, step = len(keys), 1
        order = np.argsort(keys, kind="stable")
        rank = self._ranks(keys[order], order)
        while n and rank.max() < n - 1:
            after = np.zeros(n, np.int64)
            after[: n - step] = rank[step:] + 1
            pair = rank * (n + 1) + after
            order = np.argsort(pair, kind="stable")
            rank = self._ranks(pair[order], order)
            step *= 2
        self.sample, self.n = sample, n
        bwt = runs[order - 1]  # a run's first suffix has the end of the run before it
        self.bits = max(1, int(runs.max()).bit_length()) if n else 1
        self.wavelet = WaveletMatrix(bwt.astype(np.int64), self.bits)
        self.less = np.concatenate(([0], np.cumsum(np.bincount(runs, minlength=1 << self.bits)))).astype(np.int64)
        self.bwt, self.sampled = bwt, order % sample == 0
        # a run's start can't be walked past, so it is a sample too
        self.sampled |= bwt == 0
        self.at = np.cumsum(self.sampled) - 1
        self.positions = order[self.sampled]

    @staticmethod
    def _ranks(ordered, order):
        import numpy as np

        rank = np.empty(len(order), np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))[: len(order)]
        return rank

    def search(self, patterns):
        """First and past-the-last row for each pattern; patterns are rows padded with 0 at the left."""
        import numpy as np

        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for column in reversed(range(patterns.shape[1])):
            go = np.flatnonzero((patterns[:, column] > 0) & (lo < hi))
            c = patterns[go, column]
            known = c < 1 << self.bits
            hi[go[~known]] = lo[go[~known]]
            go, c = go[known], c[known]
            lo[go], hi[go] = self.less[c] + self.wavelet.rank(c, lo[go]), self.less[c] + self.wavelet.rank(c, hi[go])
        return lo, hi

    def locate(self, rows):
        """Text positions of index rows."""
        import numpy as np

        rows, walked, out = rows.copy(), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            here = self.sampled[rows[todo]]
            done = todo[here]
            out[done] = self.positions[self.at[rows[done]]] + walked[done]
            todo = todo[~here]
            c = self.bwt[rows[todo]].astype(np.int64)
            rows[todo] = self.less[c] + self.wavelet.rank(c, rows[todo])
            walked[todo] += 1
        return out


def _shard_hits(ids: list, phrases: Phrases):
    """(document, first word, words, pattern) of each occurrence in one shard of documents' word numbers."""
    import numpy as np

    sizes = np.array([len(d) + 1 for d in ids])
    base = np.cumsum(sizes) - sizes
    flat = np.zeros(int(sizes.sum()), np.int32)
    for b, d in zip(base, ids):
        flat[b : b + len(d)] = d
    known = np.concatenate(([0], (flat > 0).view(np.int8), [0]))
    edge = np.diff(known)
    first, past = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    keep = past - first >= phrases.lengths.min()
    first, past = first[keep], past[keep]
    if not len(first):
        return [np.zeros(0, np.int64)] * 4
    width = past - first + 1
    start = np.cumsum(width) - width
    origin = np.repeat(first - start, width) + np.arange(int(width.sum()))
    runs = flat[np.minimum(origin, len(flat) - 1)]
    runs[start + width - 1] = 0
    index = FMIndex(runs)
    lo, hi = index.search(phrases.patterns)
    count = hi - lo
    which = np.repeat(np.arange(len(lo)), count)
    rows = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    at = origin[index.locate(rows)]
    doc = np.searchsorted(base, at, side="right") - 1
    return [doc, at - base[doc], phrases.lengths[which], which]


def merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


HITS = "n_words long, spans array<struct<first:int,past:int>>, items array<string>"


def _one_block(docs: DataFrame, items: list[tuple[str | None, bytes | None]], width: int, shard_bytes: int, text: int | None = None) -> DataFrame:
    """Hits of one block. ``docs`` has row and text, or only a row whose field number ``text`` is the text."""
    shared = docs.sparkSession.sparkContext.broadcast(Phrases(items, width))

    def shard(texts, phrases):
        import numpy as np

        number = phrases.vocabulary.get
        ids = [np.fromiter(map(number, words(t.as_py()), repeat(0)), np.int32) for t in texts]
        found: list[tuple[list, set]] = [([], set()) for _ in ids]
        if len(phrases.patterns):
            for d, first, n, which in zip(*(x.tolist() for x in _shard_hits(ids, phrases))):
                found[d][0].append((first, first + n))
                found[d][1].update(phrases.owners[phrases.starts[which] : phrases.starts[which + 1]].tolist())
        for own, (spans, owners) in zip(ids, found):
            yield len(own), [{"first": a, "past": b} for a, b in merged(spans)], sorted({phrases.names[n] for n in owners} - {None})

    def find(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        kind = pa.list_(pa.struct([("first", pa.int32()), ("past", pa.int32())]))
        for batch in batches:
            texts = batch.column(1) if text is None else batch.column(0).field(text)
            texts = texts.cast(pa.binary())
            # a stretch of documents, or one that is longer by itself
            ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + shard_bytes, "right")))
                counts, spans, names = zip(*shard(texts[at:to], shared.value))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(counts, pa.int64()), pa.array(spans, kind), pa.array(names, pa.list_(pa.string()))], names=["row", "n_words", "spans", "items"])
                at = to

    schema = docs.select("row").schema
    for field in StructType.fromDDL(HITS):
        schema = schema.add(field)
    out = docs.mapInArrow(tidy(find), schema)
    out.phrases = shared  # for those who are done with it before others
    return out


def find_benchmark(docs: DataFrame, benchmark: DataFrame, width: int = 13, block_bytes: int = 4 << 20, shard_bytes: int = 8 << 20, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: row (a struct of ``keep``), n_words, merged word spans of benchmark windows, the items' ids.

    A window is ``width`` consecutive words of an item, or the whole of a shorter one; an item with no
    word, such as a null text, has none. An item without an id hits like others and is only not named. The benchmark
    is sent to the tasks in blocks of at most ``block_bytes`` of text or one item, one after the other however large it is,
    and blocks' spans are merged. A null document has no words. Long texts are split a MB at a time; an index covers
    at most ``shard_bytes`` of text or one longer document. Repeated rows give a row each; an empty benchmark hits
    nothing; an empty table gives no rows; further columns are ignored, and the kept ones can have any name.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text"))
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    if blocks == 1:
        narrow = docs.select(boxed(docs, list(keep)).alias("row"), *([] if "text" in keep else [F.col("text").cast("binary").alias("text")]))
        return _one_block(narrow, [tuple(r) for r in items.collect()], width, shard_bytes, keep.index("text") if "text" in keep else None)
    numbered = materialize(docs.select(F.monotonically_increasing_id().alias("row"), F.col("text").cast("binary").alias("text"), boxed(docs, list(keep)).alias("kept")))
    cut = materialize(items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks))))
    parts = []
    for b in range(blocks):
        part = _one_block(numbered.select("row", "text"), [(r.item, r.text) for r in cut.where(F.col("block") == b).toLocalIterator()], width, shard_bytes)
        parts.append(materialize(part))
        part.phrases.destroy()  # one block at a time takes memory
    every = reduce(DataFrame.unionByName, parts)
    before = Window.partitionBy("row").orderBy("first", "past")
    spans = every.select("row", F.inline("spans")).withColumn("reach", F.max("past").over(before.rowsBetween(Window.unboundedPreceding, -1)))
    spans = spans.withColumn("island", F.count(F.when(F.col("reach").isNull() | (F.col("first") > F.col("reach")), 1)).over(before))
    spans = spans.groupBy("row", "island").agg(F.min("first").alias("first"), F.max("past").alias("past")).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("first", "past"))).alias("spans"))
    names = every.select("row", F.explode("items").alias("item")).groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    out = numbered.select("row", "kept").join(parts[0].select("row", "n_words"), "row").join(spans, "row", "left").join(names, "row", "left")
    nothing = lambda c: F.coalesce(c, F.array().cast(every.schema[c].dataType)).alias(c)
    return out.select(F.col("kept").alias("row"), "n_words", nothing("spans"), nothing("items"))


def judged(hits: DataFrame) -> DataFrame:
    """Adds n_hit, n_items, items_sha256 and contaminated: a twentieth of the words or more are hit."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["past"] - s["first"])
    hits = hits.withColumn("n_hit", n_hit).withColumn("n_items", F.size("items").cast("long"))
    hits = hits.withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256))
    return hits.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def op5_fm_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = judged(find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    return hits.select("row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP5_SQL = r"""
WITH t AS (
  SELECT 'd' || row_number() OVER () AS r, doc_id, NULL::BIGINT AS item_id, text FROM documents
  UNION ALL SELECT 'b' || row_number() OVER (), NULL, item_id, text FROM benchmark),
s AS MATERIALIZED (
  SELECT r, doc_id, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM t),
p AS (SELECT item_id, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i, w FROM s WHERE r[1] = 'b' AND len(w) > 0),
g AS (SELECT DISTINCT item_id, w[i:i + 12] AS g FROM p),
n AS (SELECT DISTINCT len(g) AS n FROM g),
o AS (SELECT r, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM s, n WHERE r[1] = 'd' AND len(w) >= n),
h AS (SELECT o.r, o.i, o.n, g.item_id FROM (SELECT r, i, n, w[i:i + n - 1] AS g FROM o) o JOIN g USING (g)),
c AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM h) GROUP BY r),
m AS (SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM (SELECT DISTINCT r, item_id FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM s LEFT JOIN c USING (r) LEFT JOIN m USING (r) WHERE r[1] = 'd'
"""
