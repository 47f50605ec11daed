"""Operator 10: language identification by interpolated Kneser-Ney character models.

Each language has a model of order 4 over lower-case letters, everything else being one space. What
all models say of an n-gram is one row of an array sorted by the n-gram's hash. A text gets the language
with the lowest cross-entropy per character, and is rejected if that exceeds what the language's own
labelled texts show.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import boxed, table, tidy

ORDER = 4
PREDICTION = "lang_pred string, score double, cross_entropy double, chars long"


class Letters:
    """Code points as letters in lower case, or 32 for all that is no letter."""

    _table = None

    @classmethod
    def table(cls):
        import numpy as np

        if cls._table is None:
            t = np.full(0x110000, 32, np.int64)
            for i in range(0x110000):
                c = chr(i)
                if c.isalpha():
                    t[i] = ord(low) if len(low := c.lower()) == 1 else i
            cls._table = t
        return cls._table

    @classmethod
    def pieces(cls, text: str, most: int = 1 << 18) -> Iterator:
        """Letters of a text, with one space for each run of other characters and at the end, up to ``most`` at a time."""
        import numpy as np

        x = np.array([32])
        for at in range(0, len(text), most):
            x = np.concatenate((x[-1:], cls.table()[np.frombuffer(text[at : at + most].encode("utf-32-le", "surrogatepass"), "<u4")]))
            yield x[1:][(x[1:] != 32) | (x[:-1] != 32)]
        yield np.full(int(x[-1] != 32), 32)

    @classmethod
    def of(cls, text: str):
        """All letters of a text in one piece."""
        import numpy as np

        return np.concatenate([*cls.pieces(text)])


def _grams(flat):
    """For each place and n = 1 ... ORDER the hash of the n characters that end there, as int64."""
    import numpy as np

    c = flat.astype(np.uint64)
    one = (c + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    out, h = [one], one
    for _ in range(ORDER - 1):
        before = np.concatenate(([np.uint64(0)], out[-1][:-1]))
        h = before * np.uint64(0xBF58476D1CE4E5B9) ^ (before >> np.uint64(29)) ^ one * np.uint64(0x94D049BB133111EB)
        out.append(h)
    return [x.view(np.int64) for x in out]


class KneserNey:
    """All languages' models. ``counts``: for each language its n-grams of ORDER characters."""

    def __init__(self, counts: dict[str, dict[str, int]]):
        import numpy as np

        self.langs = sorted(counts)
        per: list[list[Counter]] = [[Counter() for _ in self.langs] for _ in range(ORDER + 1)]
        for l, lang in enumerate(self.langs):
            per[ORDER][l].update(counts[lang])
            for n in range(ORDER - 1, 0, -1):  # below the top, in how many ways an n-gram is continued to the left
                per[n][l].update(g[1:] for g in per[n + 1][l])
        self.floor = math.log(1.0 / (1 + len({g for c in per[1] for g in c})))
        self.grams, self.logs, self.contexts, self.backs = [], [], [], []
        for n in range(1, ORDER + 1):
            grams = sorted(set().union(*per[n]))
            codes = np.array([[ord(ch) for ch in g] for g in grams], np.int64).reshape(-1, n)
            count = np.array([[c.get(g, 0) for c in per[n]] for g in grams], float).reshape(-1, len(self.langs))
            ctx = self._hash(codes[:, :-1]) if n > 1 else np.zeros(len(codes), np.int64)
            contexts, where = np.unique(ctx, return_inverse=True)
            total, kinds = np.zeros((len(contexts), len(self.langs))), np.zeros((len(contexts), len(self.langs)))
            np.add.at(total, where, count)
            np.add.at(kinds, where, count > 0)
            once, twice = (count == 1).sum(axis=0), (count == 2).sum(axis=0)
            discount = np.where(once > 0, once / np.maximum(once + 2 * twice, 1), 0.5).clip(0.05, 0.95)
            back = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            lower = np.exp(self.lookup([self._hash(codes[:, k:]) for k in range(n - 1, 0, -1)], [self._hash(codes[:, k:-1]) for k in range(n - 2, -1, -1)][: max(n - 2, 0)])) if n > 1 else np.full(count.shape, math.exp(self.floor))
            p = np.maximum(count - discount, 0) / np.maximum(total[where], 1) + back[where] * lower
            hashes = self._hash(codes)
            order = np.argsort(hashes)
            self.grams.append(hashes[order])
            self.logs.append(np.log(p[order]).astype(np.float32))
            self.contexts.append(contexts)
            self.backs.append(np.log(back).astype(np.float32))

    @staticmethod
    def _hash(codes):
        if not len(codes):
            import numpy as np

            return np.zeros(0, np.int64)
        # rows end to end: the hash at a row's last place covers just that row
        return _grams(codes.reshape(-1))[codes.shape[1] - 1][codes.shape[1] - 1 :: codes.shape[1]]

    @staticmethod
    def _find(table, keys):
        import numpy as np

        at = np.searchsorted(table, keys)
        at[at == len(table)] = 0
        return at, table[at] == keys if len(table) else np.zeros(len(keys), bool)

    def lookup(self, grams: list, contexts: list):
        """Log-probabilities (places x languages). grams[n-1], contexts[n-2]: hashes of n-grams and of the n-1 characters before the last."""
        import numpy as np

        n = len(grams)
        if not n:
            return np.full((0, len(self.langs)), self.floor, np.float32)
        at, known = self._find(self.grams[n - 1], grams[n - 1])
        out = self.logs[n - 1][at] if len(self.grams[n - 1]) else np.zeros((len(at), len(self.langs)), np.float32)
        if not known.all():
            rest = np.flatnonzero(~known)
            if n == 1:
                lower = np.full((len(rest), len(self.langs)), self.floor, np.float32)
                lower = lower + (self.backs[0][0] if len(self.backs[0]) else 0)
            else:
                lower = self.lookup([g[rest] for g in grams[: n - 1]], [c[rest] for c in contexts[: n - 2]])
                at, has = self._find(self.contexts[n - 1], contexts[n - 2][rest])
                if len(self.contexts[n - 1]):
                    lower = lower + np.where(has[:, None], self.backs[n - 1][at], 0)
            out[rest] = lower
        return out

    def cross_entropy(self, texts: list[str]):
        """(texts x languages) mean of -log p, and each text's number of characters."""
        import numpy as np

        total, sizes = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        owners, held = [], []

        def add():
            n = np.array([len(x) for x in held]) - (ORDER - 1)
            first = np.cumsum(n + ORDER - 1) - n
            p = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
            hashes, d = _grams(np.concatenate(held)), np.repeat(owners, n)
            logs = self.lookup([h[p] for h in hashes], [h[p - 1] for h in hashes[: ORDER - 1]])
            for l in range(len(self.langs)):
                total[:, l] -= np.bincount(d, logs[:, l], len(texts))
            owners.clear()
            held.clear()

        # a bounded number of places at a time, whatever the length of a text
        for i, text in enumerate(texts):
            before = np.full(ORDER - 1, 32, np.int64)
            for piece in Letters.pieces(text):
                before = np.concatenate((before[1 - ORDER :], piece))
                owners.append(i)
                held.append(before)
                sizes[i] += len(piece)
                if sum(map(len, held)) >= 1 << 18:
                    add()
        if held:
            add()
        return total / np.maximum(sizes, 1)[:, None], sizes


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _counted(batches):
    """(lang, gram, n) for each batch of (lang, text)."""
    import pyarrow as pa

    for batch in batches:
        found: Counter = Counter()
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            text = text.decode("utf-8", "replace")
            t = " " * (ORDER - 1) + "".join(map(chr, Letters.of(text).tolist()))
            found.update((lang, t[i : i + ORDER]) for i in range(len(t) - ORDER + 1))
        keys = list(found)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(found.values()), pa.int64())], names=["lang", "gram", "n"])


def _fold() -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))


def _sample(docs: DataFrame, folds: tuple[int, ...], rows: int) -> DataFrame:
    """At most ``rows`` labelled documents of each language, by the hash of their id."""
    some = docs.where(_fold().isin(*folds)).where("lang is not null and text is not null").select("lang", "doc_id", "text")
    ids = some.select("lang", "doc_id", (F.spark_partition_id() % 64).alias("part"))
    for by in (["lang", "part"], ["lang"]):  # in two levels, so that no task ranks what all others send of a language
        first = Window.partitionBy(*by).orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id")
        ids = ids.withColumn("n", F.row_number().over(first)).where(F.col("n") <= rows).drop("n")
    ids = ids.select("lang", "doc_id")
    return some.join(F.broadcast(ids), ["lang", "doc_id"], "left_semi")


def fit(docs: DataFrame, sample_rows: int = 500) -> KneserNey | None:
    """Models from at most ``sample_rows`` labelled documents of each language, whole texts each.

    Documents whose crc32(doc_id) mod 4 is 2 are never learned from, and those where it is 3 are left
    for calibration. None if no language is left. The models are held by the driver and each worker, so languages are to be
    few (hundreds): what they take grows with their number, not with the documents.
    """
    rows = _sample(docs, (0, 1), sample_rows).select("lang", F.col("text").cast("binary").alias("text")).mapInArrow(tidy(_counted), "lang string, gram string, n long")
    counts: dict[str, dict[str, int]] = {}
    for r in rows.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toLocalIterator():
        counts.setdefault(r.lang, {})[r.gram] = r.n
    return KneserNey(counts) if counts else None


def predict(docs: DataFrame, model: KneserNey | None, *keep: str) -> DataFrame:
    """row (the ``keep`` columns), lang_pred, score, cross_entropy and chars of each document, from its text alone.

    A text that is null or has no letter is ``und`` with score 0. The score is the chosen language's
    share if all were equally likely before, the text counting as 50 characters at most. Of languages with equal
    cross-entropy the first by name is taken. Bytes that are not UTF-8 count as no letters.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        model = shared.value
        for batch in (whole.slice(at, 1000) for whole in batches for at in range(0, whole.num_rows, 1000)):
            row = batch.column(0)
            texts = row.field(keep.index("text")) if "text" in keep else batch.column(1)
            texts = [None if t is None else t.decode("utf-8", "replace") for t in texts.cast(pa.binary()).to_pylist()]
            names, scores, best = ["und"] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.nan)
            sizes = np.zeros(len(texts), np.int64)
            real = [i for i, t in enumerate(texts) if model and has_letter(t)]
            for at in range(0, len(real), 256):
                some = real[at : at + 256]
                ce, n = model.cross_entropy([texts[i] for i in some])
                first = ce.argmin(axis=1)
                low = ce[np.arange(len(some)), first]
                share = 1 / np.exp(-(ce - low[:, None]) * np.minimum(n, 50)[:, None]).sum(axis=1)
                for k, i in enumerate(some):
                    names[i] = model.langs[first[k]]
                scores[some], best[some], sizes[some] = share, low, n
            yield pa.RecordBatch.from_arrays([row, pa.array(names, pa.string()), pa.array(scores), pa.array(best, from_pandas=True), pa.array(sizes)], names=["row", "lang_pred", "score", "cross_entropy", "chars"])

    narrow = docs.select(boxed(docs, list(keep)).alias("row"), *([] if "text" in keep else [F.col("text").cast("binary").alias("text")]))
    schema = narrow.select("row").schema
    for name, kind in (c.split() for c in PREDICTION.split(", ")):
        schema = schema.add(name, kind)
    return narrow.mapInArrow(tidy(run), schema)


def calibrate(docs: DataFrame, model: KneserNey | None, sample_rows: int = 500, quantile: float = 0.995, margin: float = 0.5) -> dict[str, float]:
    """The cross-entropy above which a prediction is rejected, for each language.

    ``margin`` nats above the ``quantile`` of at most ``sample_rows`` labelled texts that the models
    have not seen; a language without such texts rejects nothing.
    """
    if model is None:
        return {}
    own = predict(_sample(docs, (3,), sample_rows), model, "lang").where("row.lang = lang_pred")
    return {r.lang: r.q + margin for r in own.groupBy("row.lang").agg(F.percentile("cross_entropy", F.lit(quantile)).alias("q")).collect()}


def identify(docs: DataFrame, *keep: str) -> DataFrame:
    """``predict`` with models learned from ``docs``, and ``rejected``: und, or too unlike its language.

    The ``keep`` columns come as one struct, ``row``, whatever their names. A null doc_id is not learned from. Repeated rows are predicted once each. Without any labelled
    document all are ``und``; an empty table gives no rows. As a short text's cross-entropy varies
    more, 4 / sqrt(characters) nats are added to the limit.
    """
    model = fit(docs)
    most = calibrate(docs, model)
    out = predict(docs, model, *keep)
    limit = F.lit(float("inf"))
    for lang, value in sorted(most.items()):
        limit = F.when(F.col("lang_pred") == lang, value).otherwise(limit)
    return out.withColumn("rejected", (F.col("lang_pred") == "und") | F.coalesce(F.col("cross_entropy") > limit + 4 / F.sqrt("chars"), F.lit(False)))


def op10_kneser_ney_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, "doc_id").withColumn("doc_id", F.col("row.doc_id"))
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(_fold() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
