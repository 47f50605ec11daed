"""Operator 6: removing byte strings that occur elsewhere, by merged Burrows-Wheeler transforms.

Every string of ``length`` bytes is anchored at the least hash among the ``seed`` bytes' windows in it,
so equal strings have equal anchors. Strings around anchors that occur once cannot repeat, and runs
of strings around one anchor whose whole bytes are equal all repeat. What is left are anchors with
several different surroundings. These are dealt by anchor; in each bundle the surroundings form
shards, whose Burrows-Wheeler transforms are merged by refining their interleave one symbol at a time.
The round in which two neighbours part is their common prefix, so intervals that are still whole
after ``length`` rounds are the repeated strings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, slices, table, tidy

#: Bytes of a symbol in the Burrows-Wheeler transforms, cut from the anchor to both sides.
SYMBOL = 8
_BASE = 0x9E3779B97F4A7C15
_POS = (1 << 24) - 1


def _power(base: int, n: int) -> int:
    return pow(base, n, 1 << 64)


class Anchors:
    """Anchors of texts: hashes of all ``seed``-byte windows and the least in each ``length`` bytes."""

    def __init__(self, length: int, seed: int):
        import numpy as np

        self.length, self.seed = length, seed
        x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
        self.of_byte = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        import numpy as np

        if n > len(self.up):
            size = max(n, 2 * len(self.up))
            for name, base in (("up", _BASE), ("down", _power(_BASE, (1 << 63) - 1))):
                p = np.full(size, np.uint64(base))
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))

    def find(self, text: bytes):
        """(first, last, anchor, anchor hash, content hash): runs of starts of strings with one anchor."""
        import numpy as np

        none = [np.zeros(0, np.int64)] * 5
        if len(text) < self.length:
            return none
        step, parts = 1 << 21, []  # a block takes about 80 times its bytes
        for at in range(0, len(text) - self.length + 1, step):
            parts.append(self._block(text[at : at + step + self.length - 1], at))
        return [np.concatenate(p) for p in zip(*parts)]

    def _block(self, text: bytes, offset: int):
        import numpy as np

        n = len(text)
        one = self.of_byte[np.frombuffer(text, np.uint8)]
        h, m = one, 1
        while m < self.seed:
            h = h[: len(h) - m] * np.uint64(_power(_BASE, m)) + h[m:]
            m *= 2
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        least = (h & ~np.uint64(_POS)) | np.arange(len(h), dtype=np.uint64)
        width, m = self.length - self.seed + 1, 1
        while 2 * m <= width:
            least = np.minimum(least[: len(least) - m], least[m:])
            m *= 2
        least = np.minimum(least[: len(least) - (width - m)], least[width - m :])
        first = np.concatenate(([0], np.flatnonzero(least[1:] != least[:-1]) + 1))
        last = np.concatenate((first[1:] - 1, [len(least) - 1]))
        self._powers(n + 1)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(one * self.up[:n], dtype=np.uint64)))
        content = (total[last + self.length] - total[first]) * self.down[first] + (last - first).astype(np.uint64)
        at = (least[first] & np.uint64(_POS)).astype(np.int64)
        return [first + offset, last + offset, at + offset, h[at].view(np.int64), content.view(np.int64)]




class Shard:
    """The transform of some surroundings' symbols; each ends in a symbol of its own, less than all."""

    def __init__(self, texts: list):
        import numpy as np

        sizes = np.array([len(t) + 1 for t in texts])
        ends = np.cumsum(sizes) - 1
        n = int(sizes.sum())
        symbols = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        inside[ends] = False
        symbols[inside] = np.concatenate(texts) if texts else symbols[:0]
        keys = symbols + len(texts)
        keys[ends] = np.arange(len(texts))
        order = np.argsort(keys, kind="stable")
        rank, step = self._ranks(keys[order], order), 1
        while n and rank.max() < n - 1:
            after = np.zeros(n, np.int64)
            after[: n - step] = rank[step:] + 1
            pair = rank * (n + 1) + after
            order = np.argsort(pair, kind="stable")
            rank, step = self._ranks(pair[order], order), 2 * step
        self.rows, self.ends = order, len(texts)
        self.bwt = symbols[order - 1].astype(np.int32)  # 0 before a first symbol

    @staticmethod
    def _ranks(ordered, order):
        import numpy as np

        rank = np.empty(len(order), np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))[: len(order)]
        return rank


def merge(shards: list[Shard], depth: int):
    """(shard of each merged row, common prefix with the row before, up to ``depth``).

    Round i takes the order of all suffixes by their first i symbols to the order by i + 1: the symbol
    before each suffix, stably sorted, deals the rows anew. End symbols keep their places. Rows that a
    round first tells apart have i symbols in common.
    """
    import numpy as np

    z = np.repeat(np.arange(len(shards), dtype=np.int16), [len(s.bwt) for s in shards])
    block = np.zeros(len(z), np.int64)
    tops = np.repeat(np.arange(len(shards), dtype=np.int16), [s.ends for s in shards])
    lcp = np.full(len(z), depth, np.int32)
    open_ = np.ones(len(z), bool)
    symbols = np.empty(len(z), np.int32)
    for i in range(depth):
        for k, s in enumerate(shards):
            symbols[z == k] = s.bwt
        real = np.flatnonzero(symbols)
        order = real[np.argsort(symbols[real], kind="stable")]
        sym, blk = symbols[order], block[order]
        apart = np.ones(len(z), bool)
        e = len(tops)
        apart[e + 1 :] = (sym[1:] != sym[:-1]) | (blk[1:] != blk[:-1])
        z = np.concatenate((tops, z[order]))
        lcp[apart & open_] = i
        open_ &= ~apart
        block = np.cumsum(apart)
        if not open_.any():
            break
    return z, lcp


def repeated_starts(contents: list[tuple[bytes, int, int]], length: int, shards: int = 4):
    """For each (bytes, anchor, starts) the starts below ``starts`` whose string another content has too.

    Also a boolean array each. A string of ``length`` bytes holds ``(length - 7) // 8`` whole symbols
    from the first it covers, so it can only repeat in an interval with that common prefix; there the
    strings' own hashes decide.
    """
    import numpy as np

    depth = (length - SYMBOL + 1) // SYMBOL
    first = [a % SYMBOL for _, a, _ in contents]
    count = [(len(b) - f) // SYMBOL for (b, _, _), f in zip(contents, first)]
    flat = np.frombuffer(b"".join(b[f : f + SYMBOL * n] for (b, _, _), f, n in zip(contents, first, count)), "<u8")
    numbers = np.unique(flat, return_inverse=True)[1] + 1
    parts = np.split(numbers, np.cumsum(count)[:-1])
    built, origin = [], []
    for k in range(min(shards, len(contents))):
        own = range(k, len(contents), shards)
        built.append(Shard([parts[i] for i in own]))
        origin.append(np.concatenate([np.stack((np.full(count[i] + 1, i), np.arange(count[i] + 1)), 1) for i in own]))
    z, lcp = merge(built, depth)
    where = np.empty((len(z), 2), np.int64)
    for k, s in enumerate(built):
        where[z == k] = origin[k][s.rows]
    same = lcp >= depth
    same[:1] = False
    member = same.copy()
    member[:-1] |= same[1:]
    interval = np.cumsum(~same)[member]
    doc, symbol = where[member].T
    out = [np.zeros(n, bool) for _, _, n in contents]
    if not len(doc):
        return out
    # a hash of every string of ``length`` bytes, from running sums over all contents
    size = np.array([len(b) for b, _, _ in contents])
    base = np.cumsum(size) - size
    anchors = Anchors(length, SYMBOL)
    one = anchors.of_byte[np.frombuffer(b"".join(b for b, _, _ in contents), np.uint8)]
    anchors._powers(len(one) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(one * anchors.up[: len(one)], dtype=np.uint64)))
    first, starts = np.array(first), np.array([n for _, _, n in contents])
    for e in range(SYMBOL):
        s = first[doc] + SYMBOL * symbol - e
        ok = (s >= 0) & (s < starts[doc])
        d, at = doc[ok], s[ok] + base[doc[ok]]
        value = (total[at + length] - total[at]) * anchors.down[at]
        pair = np.stack((interval[ok].astype(np.uint64), value), 1)
        order = np.lexsort(pair.T)
        equal = (pair[order][1:] == pair[order][:-1]).all(axis=1)
        hit = np.zeros(len(order), bool)
        hit[:-1] |= equal
        hit[1:] |= equal
        for i, x in zip(d[order[hit]].tolist(), (at - base[d])[order[hit]].tolist()):
            out[i][x] = True
    return out


# a run's place is packed into one long: 16 bits that tell texts apart, 32 of the first start, 8 each of its length and anchor
def _unpacked(c: str = "place") -> list[F.Column]:
    p = F.col(c)
    return [F.shiftrightunsigned(p, 16).bitwiseAND(F.lit(0xFFFFFFFF)).alias("s0"), F.shiftrightunsigned(p, 8).bitwiseAND(F.lit(255)).alias("more"), p.bitwiseAND(F.lit(255)).alias("anchor")]


def anchored(docs: DataFrame, length: int, seed: int) -> DataFrame:
    """t, place, h, c: runs of string starts with their text, place, anchor hash and content hash."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        anchors = Anchors(length, seed)
        for batch in slices(batches):
            found = [anchors.find(t) for t in batch.column(2).to_pylist()]
            n = [len(x[0]) for x in found]
            if not sum(n):
                continue
            t, tag = (np.repeat(np.asarray(batch.column(i)), n) for i in (0, 1))
            s0, s1, at, h, c = (np.concatenate(x) for x in zip(*found))
            place = tag << 48 | s0 << 16 | (s1 - s0) << 8 | (at - s0)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (t, place, h, c)], names=["t", "place", "h", "c"])

    return docs.select("t", "tag", "body").mapInArrow(tidy(run), "t long, place long, h long, c long")


def named(docs: DataFrame) -> DataFrame:
    """doc_id, body (a text's bytes, none for null), t and tag: 80 bits that name equal texts alike."""
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), body.alias("body"), F.xxhash64(body).alias("t"), F.crc32(body).bitwiseAND(F.lit(0xFFFF)).alias("tag"))


def packed(docs: DataFrame) -> DataFrame:
    """``named`` with the body compressed, for shuffles of whole texts."""

    def run(batches):
        import pyarrow as pa
        import zstandard

        z = zstandard.ZstdCompressor(level=3)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([z.compress(x) for x in b.column(1).to_pylist()], pa.binary()), b.column(2), b.column(3)], names=b.schema.names)

    return named(docs).mapInArrow(tidy(run), "doc_id long, body binary, t long, tag long")


def _unpack(bodies: list[bytes]) -> list[bytes]:
    import zstandard

    z = zstandard.ZstdDecompressor()
    return [z.decompress(b) for b in bodies]


CONTENT = "h long, t long, tag long, s0 long, starts int, anchor int, alone boolean, content binary"
SPANS = "t long, tag long, first long, past long"


def _ambiguous(spans_of: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """Contents of the runs in ``spans_of`` (t, tag, doc_id, runs), each text read from one document."""

    def run(batches):
        import pyarrow as pa

        kinds = pa.schema([("h", pa.int64()), ("t", pa.int64()), ("tag", pa.int64()), ("s0", pa.int64()), ("starts", pa.int32()), ("anchor", pa.int32()), ("alone", pa.bool_()), ("content", pa.binary())])
        for b in slices(batches):
            rows = []
            for t, tag, body, runs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), _unpack(b.column(2).to_pylist()), b.column(3).to_pylist()):
                rows += [(r["h"], t, tag, r["s0"], r["more"] + 1, r["anchor"], r["alone"], body[r["s0"] : r["s0"] + r["more"] + length]) for r in runs]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * len(kinds), kinds)], schema=kinds)

    joined = docs.withColumnRenamed("doc_id", "own").join(spans_of, ["t", "tag"]).where(F.col("own").eqNullSafe(F.col("doc_id")))
    return joined.select("t", "tag", "body", "runs").mapInArrow(tidy(run), CONTENT)


def _merged_spans(contents: DataFrame, length: int, bundle: int) -> DataFrame:
    """Repeated strings among contents with one anchor, which must be few enough for one task."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def result(group):
            # a text that several rows of one id hold came more than once
            unique = list({(t, tag, s0): (content, anchor, starts, alone) for _, t, tag, s0, starts, anchor, alone, content in group}.items())
            found = repeated_starts([(c, a, n) for _, (c, a, n, _) in unique], length)
            rows = []
            for ((t, tag, s0), (_, _, _, alone)), hit in zip(unique, found):
                if alone and hit.any():
                    edge = np.diff(np.concatenate(([0], hit.view(np.int8), [0])))
                    rows += [(t, tag, s0 + a, s0 + b - 1 + length) for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())]
            cols = list(zip(*rows)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["t", "tag", "first", "past"])

        group, held, last = [], 0, None
        for batch in slices(batches):
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != last and held >= bundle:
                    yield result(group)
                    group, held = [], 0
                group.append(row)
                held, last = held + len(row[-1]), row[0]
        if group:
            yield result(group)

    return contents.repartition("h").sortWithinPartitions("h").mapInArrow(tidy(run), SPANS)


def _counted_spans(contents: DataFrame, length: int) -> DataFrame:
    """The same for anchors with very many contents, by counting the hash of each string."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in slices(batches):
            cols = [[], [], [], [], []]
            for h, t, tag, s0, starts, _, _, content in zip(*(c.to_pylist() for c in b.columns)):
                anchors = Anchors(length, SYMBOL)
                one = anchors.of_byte[np.frombuffer(content, np.uint8)]
                anchors._powers(len(one) + 1)
                total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(one * anchors.up[: len(one)], dtype=np.uint64)))
                at = np.arange(starts)
                value = (total[at + length] - total[at]) * anchors.down[at]
                for c, x in zip(cols, (np.full(starts, h), np.full(starts, t), np.full(starts, tag), at + s0, value.view(np.int64))):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.zeros(0, np.int64)) for c in cols], names=["h", "t", "tag", "first", "value"])

    rows = contents.mapInArrow(tidy(run), "h long, t long, tag long, first long, value long").distinct()
    twice = rows.groupBy("h", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows.join(twice, ["h", "value"], "left_semi").select("t", "tag", "first", (F.col("first") + length).alias("past"))


def repeated_spans(docs: DataFrame, length: int = 200, seed: int = 32, dense: int = 8192, bundle: int = 1 << 21) -> DataFrame:
    """t, tag and an array of spans (first, past) of bytes that a repeated string covers, for each text with any."""
    texts = named(docs)
    runs = anchored(texts, length, seed)
    # anchors that occur more than once, and whether their surroundings differ
    twice = runs.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("n > 1")
    placed = materialize(runs.join(twice.select("h", (F.col("lo") != F.col("hi")).alias("several")), "h"))
    tag, (s0, more, anchor) = F.shiftrightunsigned("place", 48).alias("tag"), _unpacked()
    span = [F.col("t"), tag, s0, (s0 + more + length).alias("past")]

    several = placed.where("several")
    per = several.groupBy("h", "c").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("t", "place")).alias("one"))
    per = materialize(per)
    whole = placed.where("not several").select(span).unionByName(several.join(per.where("n > 1").select("h", "c"), ["h", "c"], "left_semi").select(span))
    whole = whole.toDF("t", "tag", "first", "past")

    sizes = per.groupBy("h").agg(F.count(F.lit(1)).alias("contents"))
    chosen = per.join(sizes, "h").select(F.col("one.t").alias("t"), F.col("one.place").alias("place"), "h", "contents", (F.col("n") == 1).alias("alone"))
    holders = texts.groupBy("t", "tag").agg(F.min("doc_id").alias("doc_id"))

    def contents(which: DataFrame) -> DataFrame:
        per_text = which.select("t", tag, F.struct("h", s0, more, anchor, "alone").alias("run")).groupBy("t", "tag").agg(F.collect_list("run").alias("runs"))
        return _ambiguous(per_text.join(holders, ["t", "tag"]), packed(docs), length)

    found = [whole, _merged_spans(contents(chosen.where(F.col("contents") <= dense)), length, bundle)]
    if sizes.where(F.col("contents") > dense).limit(1).count():
        found.append(_counted_spans(contents(chosen.where(F.col("contents") > dense)), length))
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    return every.groupBy("t", "tag").agg(F.collect_set(F.struct("first", "past")).alias("spans"))


CUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def merged(spans) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def remove_repeats(docs: DataFrame, length: int = 200, digest: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept: the bytes that no repeated string covers.

    With ``digest`` kept is the SHA-256 of those bytes. Texts under ``length`` bytes and null texts, which
    count as empty, lose nothing. Equal texts, repeated rows too, repeat in full. Kept bytes need not be
    valid UTF-8. An empty table gives no rows; further columns are ignored.
    """
    import hashlib

    def run(batches):
        import pyarrow as pa

        for b in slices(batches):
            rows = []
            for doc_id, body, spans in zip(b.column(0).to_pylist(), _unpack(b.column(1).to_pylist()), b.column(2).to_pylist()):
                cut = merged((s["first"], s["past"]) for s in spans or [])
                kept = b"".join(body[a:e] for a, e in zip([0, *(x[1] for x in cut)], [*(x[0] for x in cut), len(body)])) if cut else body
                rows.append((doc_id, len(body), len(body) - len(kept), len(cut), hashlib.sha256(kept).digest() if digest else kept))
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    spans = materialize(repeated_spans(docs, length))
    return packed(docs).join(spans, ["t", "tag"], "left").select("doc_id", "body", "spans").mapInArrow(tidy(run), CUT)


def op6_bwt_merge_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"), digest=True)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.lower(F.hex("kept")).alias("kept_sha256"))


OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
s AS (SELECT r, x, unnest(range(0, length(x) // 2 - 199)) AS i FROM d WHERE length(x) >= 400),
h AS MATERIALIZED (SELECT r, i, md5_number(substr(x, 2 * i + 1, 400)) AS k FROM s),
g AS (SELECT r, i FROM h WHERE k IN (SELECT k FROM h GROUP BY k HAVING count(*) > 1)),
b AS (SELECT r, i, i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 200 AS goes_on FROM g),
n AS (SELECT r, i, count(*) FILTER (WHERE goes_on IS NOT true) OVER (PARTITION BY r ORDER BY i) AS run FROM b),
p AS (SELECT r, min(i) AS a, max(i) + 200 AS e FROM n GROUP BY r, run),
q AS (SELECT r, a, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM p),
t AS (SELECT r, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head, max(e) AS past, sum(e - a)::BIGINT AS n_removed, count(*) AS n_spans FROM q JOIN d USING (r) GROUP BY r)
SELECT doc_id, length(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN t.r IS NULL THEN x ELSE head || substr(x, 2 * past + 1) END)) AS kept_sha256
FROM d LEFT JOIN t USING (r)
"""
