"""Operator 13: collocations by mergeable Misra-Gries summaries, then exact counts.

A block of texts sends each hash partition its distinct n-grams of one to three words, sorted, with their counts. A partition
folds them into a summary of at most ``capacity`` counters, more than its mass divided by the threshold: where there are more,
the count past the capacity is taken off all. Whatever is taken off, in all ``lost``, stays under the threshold, so an
n-gram that occurs so often is still there, and one whose count with ``lost`` does not reach it is not frequent. The
partition answers each block which of the n-grams sent are left. Only those are counted by their words in the second pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, pieces, table, tidy
from .scoring import _pack, _unpack

ORDERS = (1, 2, 3)
BITS = 21  # of a word's number in a block: three of them are one integer
_TABLE = bytes(10 if c in b".,;:!?\n\v\f\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
UNKNOWN = "und"


class Summary:
    """Misra-Gries counters of hashed items with counts: a true count is at most the counter and ``lost``, at least the counter."""

    def __init__(self, capacity: int):
        import numpy as np

        self.capacity, self.lost = capacity, 0
        self.items, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, items, counts, lost: int = 0) -> None:
        """Add items, each as often as it is given with any counts, or merge the counters of a summary that lost ``lost``."""
        import numpy as np

        every, place = np.unique(np.concatenate((self.items, items)), return_inverse=True)
        total = np.zeros(len(every), np.int64)
        np.add.at(total, place, np.concatenate((self.counts, counts.astype(np.int64))))
        self.lost += lost
        if len(every) > self.capacity:
            off = int(np.partition(total, len(total) - self.capacity - 1)[len(total) - self.capacity - 1])
            total -= off
            self.lost += off
        self.items, self.counts = every[total > 0], total[total > 0]

    def frequent(self, threshold: int):
        """Items that may occur ``threshold`` times, sorted: all that do are among them."""
        return self.items[self.counts + self.lost >= threshold]


def tokens(text: bytes) -> list[bytes]:
    """Words and, for each place where a piece ends, ``\\n``."""
    return [w for w in text.translate(_TABLE).replace(b"\n", b" \n ").split(b" ") if w]


def _tail(text: bytes) -> bytes:
    """The last words of the last piece of ``text``, which n-grams across a cut behind it need."""
    last = text.translate(_TABLE).rpartition(b"\n")[2]
    return b" ".join([w for w in last.split(b" ") if w][1 - ORDERS[-1] :])


def blocks(batches, block_bytes: int, at_once: int = 1 << 20):
    """(block number, {language: (texts, repeats)}) of a task's documents (text, lang), in their order.

    A text that is cut goes on behind its last words again, in the same block or the next; what that counts twice is
    in ``repeats``. Texts of one language stand with a line end between them, which no n-gram crosses.
    """
    from pyspark import TaskContext

    number, held, size = TaskContext.get().partitionId() << 20, {}, 0
    for batch in batches:
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            before = b""
            for piece in pieces(text or b"", at_once):
                texts, repeats = held.setdefault(lang, ([], []))
                texts.append(before + piece)
                if before:
                    repeats.append(before)
                before = _tail(before + piece)
                size += len(piece)
                if size >= block_bytes:
                    yield number, {k: (b"\n".join(a), b"\n".join(b)) for k, (a, b) in held.items()}
                    number, held, size = number + 1, {}, 0
    if held:
        yield number, {k: (b"\n".join(a), b"\n".join(b)) for k, (a, b) in held.items()}


class Grams:
    """The distinct n-grams of a block by their hashes: ``hashes`` and ``counts`` of all languages and orders, sorted."""

    def __init__(self, block: dict[str, tuple[bytes, bytes]]):
        import numpy as np
        import xxhash

        numbers = {b"\n": 0}
        self.parts = []  # (language, order, keys, counts, hashes)
        self.words: dict[str, int] = {}
        read = {}
        for lang, texts in block.items():
            for t in texts:
                found = tokens(t)
                for w in set(found).difference(numbers):
                    numbers[w] = len(numbers)
                read.setdefault(lang, []).append(np.array(list(map(numbers.__getitem__, found)), np.int64))
        if len(numbers) >= 1 << BITS:
            raise ValueError("a block has too many words: make block_bytes smaller")
        self.spelled = list(numbers)
        of_word = np.fromiter(map(xxhash.xxh64_intdigest, self.spelled), np.uint64, len(self.spelled))
        for lang, (ids, again) in read.items():
            self.words[lang] = int((ids > 0).sum() - (again > 0).sum())
            seed = xxhash.xxh64_intdigest(lang.encode())
            for n in ORDERS:
                keys, counts = np.unique(self._keys(ids, n), return_counts=True)
                np.subtract.at(counts, np.searchsorted(keys, self._keys(again, n)), 1)
                keys, counts = keys[counts > 0], counts[counts > 0]
                h = np.full(len(keys), (seed + n) & (1 << 64) - 1, np.uint64)
                for k in reversed(range(n)):
                    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + of_word[(keys >> (BITS * k)) & ((1 << BITS) - 1)] * np.uint64(0x9E3779B97F4A7C15)
                h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
                self.parts.append((lang, n, keys, counts, h ^ (h >> np.uint64(31))))
        hashes = np.concatenate([p[4] for p in self.parts] or [np.zeros(0, np.uint64)])
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]
        self.counts = np.concatenate([p[3] for p in self.parts] or [np.zeros(0, np.int64)])[self.order]

    @staticmethod
    def _keys(ids, n: int):
        """The n-grams of ``ids`` as integers, none across a piece's end."""
        import numpy as np

        size = max(0, len(ids) - n + 1)
        keys, whole = np.zeros(size, np.int64), np.ones(size, bool)
        for k in range(n):
            keys = (keys << BITS) | ids[k : k + size]
            whole &= ids[k : k + size] > 0
        return keys[whole]

    def spell(self, left):
        """(language, order, phrase, count) columns of the n-grams that are ``left``, a mask in the order of ``hashes``."""
        import numpy as np

        kept, at = np.zeros(len(self.order), bool), 0
        kept[self.order] = left
        mask, langs, orders, phrases, counts = (1 << BITS) - 1, [], [], [], []
        for lang, n, keys, count, _ in self.parts:
            mine = kept[at : at + len(keys)]
            at += len(keys)
            keys = keys[mine]
            columns = [[self.spelled[i] for i in ((keys >> (BITS * k)) & mask).tolist()] for k in reversed(range(n))]
            phrases += columns[0] if n == 1 else map(b" ".join, zip(*columns))
            langs += [lang] * len(keys)
            orders += [n] * len(keys)
            counts += count[mine].tolist()
        return langs, orders, phrases, counts


def frequent_ngrams(docs: DataFrame, threshold: int = 10, block_bytes: int = 6 << 20, stable: bool = False) -> DataFrame:
    """(lang, k, phrase, f): all n-grams of ``k`` = 1 to 3 words that occur at least ``threshold`` times in texts of a language.

    With k = 0, phrase null: all words of the language. See ``collocations`` for words, pieces, null and odd texts.
    Documents are read twice and must come in the same order, as from files; else leave ``stable`` false
    and they are written to the shared folder first.
    """
    narrow = docs.select(F.col("text").cast("binary").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"))
    if not stable:
        narrow = materialize(narrow)
    buckets = max(64, 4 * narrow.rdd.getNumPartitions())

    def explode(batches):
        import numpy as np
        import pyarrow as pa

        for number, block in blocks(batches, block_bytes):
            grams, rows = Grams(block), []
            # buckets are ranges of the hash, so their parts end to end are sorted
            bucket = ((grams.hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            cuts = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
            for b in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
                part = slice(cuts[b], cuts[b + 1])
                rows.append((number, b, _pack(np.diff(grams.hashes[part], prepend=np.uint64(0))), _pack(grams.counts[part].astype(np.uint32))))
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["block", "bucket", "hashes", "counts"])

    def summarize(pdf):
        import numpy as np
        import pandas as pd

        counts = [_unpack(c, "<u4") for c in pdf.counts]
        summary = Summary(int(sum(int(c.sum(dtype=np.int64)) for c in counts)) // threshold + 1)
        hashes = lambda h: np.cumsum(_unpack(h, "<u8"), dtype=np.uint64)
        waiting, size = [], 0
        for h, c in [*zip(pdf.hashes, counts), (None, None)]:
            if h is not None:
                waiting.append((hashes(h), c))
                size += len(c)
            if waiting and (h is None or size >= 2 * summary.capacity):
                summary.add(np.concatenate([x for x, _ in waiting]), np.concatenate([x for _, x in waiting]))
                waiting, size = [], 0
        left = summary.frequent(threshold)
        answers = []
        for h in pdf.hashes:
            asked = hashes(h)
            at = np.searchsorted(left, asked)
            answers.append(np.packbits(left[np.minimum(at, len(left) - 1)] == asked if len(left) else np.zeros(len(asked), bool)).tobytes())
        return pd.DataFrame({"block": pdf.block, "bucket": pdf.bucket, "size": [len(c) for c in counts], "kept": answers})

    def texts(batches):
        import pyarrow as pa
        import zstandard

        z = zstandard.ZstdCompressor(level=3)
        for number, block in blocks(batches, block_bytes):
            rows = [(number, at, lang, z.compress(a), z.compress(b)) for at, (lang, (a, b)) in enumerate(block.items())]  # numbers of words depend on the order
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.string(), pa.binary(), pa.binary()))], names=["block", "at", "lang", "texts", "repeats"])

    def count(own, answers):
        import numpy as np
        import pyarrow as pa
        import zstandard

        z = zstandard.ZstdDecompressor()
        grams = Grams({r["lang"]: (z.decompress(r["texts"]), z.decompress(r["repeats"])) for r in own.sort_by("at").to_pylist()})
        parts = sorted(answers.to_pylist(), key=lambda r: r["bucket"])
        left = np.concatenate([np.unpackbits(np.frombuffer(r["kept"], np.uint8), count=r["size"]).astype(bool) for r in parts] or [np.zeros(0, bool)])
        langs, orders, phrases, counts = grams.spell(left)
        langs += grams.words
        orders += [0] * len(grams.words)
        phrases += [None] * len(grams.words)
        counts += grams.words.values()
        return pa.table({"lang": pa.array(langs, pa.string()), "k": pa.array(orders, pa.int32()), "phrase": pa.array(phrases, pa.binary()), "f": pa.array(counts, pa.int64())})

    sent = narrow.mapInArrow(tidy(explode), "block long, bucket int, hashes binary, counts binary")
    answers = materialize(sent.groupBy("bucket").applyInPandas(summarize, "block long, bucket int, size long, kept binary"))
    own = narrow.mapInArrow(tidy(texts), "block long, at int, lang string, texts binary, repeats binary")
    exact = own.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(count, "lang string, k int, phrase binary, f long")
    total = exact.groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= threshold) | (F.col("k") == 0))
    return materialize(total.withColumn("phrase", F.col("phrase").cast("string")))


def collocations(docs: DataFrame, threshold: int = 10, inside: int = 50, most: int = 2000, block_bytes: int = 6 << 20, stable: bool = False, salts: int = 64) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``most`` best phrases of two or three words.

    Words are what stands between blanks and tabs, A-Z in lower case, and pieces end at ``.,;:!?`` and line ends; no phrase crosses
    a piece's end. A phrase occurs ``a`` times, ``threshold`` at least, overlaps included. It is cut in two where floor(10**6 a a / (l r)) is
    least, earliest if several are, with l and r the occurrences of its sides. Left out are phrases inside a longer one with
    at least ``inside`` percent of their occurrences. Order: score, then a, both descending, then phrase byte by byte. n: all words of the language.
    A null language is ``und``. Null, empty and blank texts have no words; repeated rows count each; further columns
    are ignored; long texts are cut between words and lose no phrase. An empty table gives no rows.
    """
    found = frequent_ngrams(docs, threshold, block_bytes, stable)
    grams = found.where("k > 0")
    cut = lambda i: F.struct(F.lit(i).alias("cut"), F.substring_index("phrase", " ", i).alias("left"), F.expr(f"substring(phrase, length(substring_index(phrase, ' ', {i})) + 2)").alias("right"))
    cuts = F.when(F.col("k") == 2, F.array(cut(1))).otherwise(F.array(cut(1), cut(2)))
    sides = found.where("k > 1").select("lang", "k", "phrase", F.col("f").alias("a"), F.explode(cuts).alias("c")).select("lang", "k", "phrase", "a", "c.*")
    part = lambda side, f: grams.select("lang", F.col("phrase").alias(side), F.col("f").alias(f)).hint("merge")
    sides = sides.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    score = F.call_function("div", wide("a") * wide("a") * F.lit(1_000_000).cast("decimal(7,0)"), wide("l") * wide("r"))
    best = sides.withColumn("score", score).groupBy("lang", "k", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b"))
    longer = found.where("k = 3").select("lang", "f", F.explode(F.array(F.substring_index("phrase", " ", 2), F.substring_index("phrase", " ", -2))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("f").alias("longest"), F.lit(2).alias("k"))
    kept = best.join(longer.hint("merge"), ["lang", "phrase", "k"], "left").where(F.col("longest").isNull() | (100 * F.col("longest") < inside * F.col("a")))
    rows = kept.select("lang", "phrase", "a", "b.l", "b.r", "b.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    first = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    # ranked within pieces of a language first: what then meets is ``most`` for each piece
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(salts))).withColumn("rank", first("lang", "_salt")).where(F.col("rank") <= most)
    rows = rows.withColumn("rank", first("lang")).where(F.col("rank") <= most)
    sizes = found.where("k = 0").select("lang", F.col("f").alias("n"))
    return rows.join(sizes.hint("merge"), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_misra_gries_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"), stable=True)


OP13_SQL = r"""
WITH p AS (
  SELECT row_number() OVER () AS p, lang, piece FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
t AS (SELECT p, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
u AS (SELECT p, lang, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM t),
w AS MATERIALIZED (SELECT lang, w AS w1, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM u WINDOW o AS (PARTITION BY p ORDER BY i)),
n AS (SELECT lang, count(*) AS n FROM w GROUP BY lang),
f1 AS MATERIALIZED (SELECT lang, w1, count(*) AS f FROM w GROUP BY ALL),
f2 AS MATERIALIZED (SELECT lang, w1, w2, count(*) AS f FROM w WHERE w2 IS NOT NULL GROUP BY ALL),
f3 AS MATERIALIZED (SELECT lang, w1, w2, w3, count(*) AS f FROM w WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
c AS (
  SELECT x.lang, x.w1 || ' ' || x.w2 AS phrase, x.f AS a, 1 AS cut, a.f AS l, b.f AS r FROM f2 x JOIN f1 a USING (lang, w1) JOIN f1 b ON b.lang = x.lang AND b.w1 = x.w2
  WHERE x.f >= 10 AND NOT EXISTS (SELECT 1 FROM f3 y WHERE y.lang = x.lang AND y.w1 = x.w1 AND y.w2 = x.w2 AND 100 * y.f >= 50 * x.f)
    AND NOT EXISTS (SELECT 1 FROM f3 y WHERE y.lang = x.lang AND y.w2 = x.w1 AND y.w3 = x.w2 AND 100 * y.f >= 50 * x.f)
  UNION ALL SELECT x.lang, concat_ws(' ', x.w1, x.w2, x.w3), x.f, 1, a.f, b.f FROM f3 x JOIN f1 a USING (lang, w1) JOIN f2 b ON b.lang = x.lang AND b.w1 = x.w2 AND b.w2 = x.w3
  UNION ALL SELECT x.lang, concat_ws(' ', x.w1, x.w2, x.w3), x.f, 2, a.f, b.f FROM f3 x JOIN f2 a USING (lang, w1, w2) JOIN f1 b ON b.lang = x.lang AND b.w1 = x.w3),
s AS (SELECT *, (1000000::HUGEINT * a * a // (l::HUGEINT * r))::BIGINT AS score FROM c),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n.n, score
FROM b JOIN n USING (lang) QUALIFY rank <= 2000
"""
