"""Operator 8: near-duplicate documents by SimHash fingerprints.

A fingerprint's segments are embedded as their bit counts, and the Manhattan distance of two such
vectors is at most the fingerprints' Hamming distance. With more segments than allowed differences
some segments of a linked pair agree, so links are sought in the cells of a grid: a choice of agreeing
segments with their bits, and overlapping ranges of the bit count of the rest. Within a cell the
Manhattan bound comes first and the exact distance decides. The more fingerprints, the more segments:
the bits that agree in a cell keep up with the fingerprints' number, and cells stay small.

Where fingerprints crowd all the same, as edits of one text do, a cell with more than ``dense`` of them is not
paired. They are hung on every point within half the distance instead: two of them share a point just when
they link, and all that share one link with each other, so the least at each point stands for it. That takes
work in proportion to the fingerprints, and loses no link.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import boxed, materialize, pieces, table, tidy, unboxed
from .components import components


def fingerprint_of(text: bytes | None, width: int = 4, seed: int = 42, at_once: int = 1 << 20) -> int:
    """64 bits: each set if it is set in over half of the shingles' XXH64; no words give zero.

    About ``at_once`` bytes of text are taken apart at a time; the last words of each go on to the next.
    """
    from itertools import repeat

    import numpy as np
    import xxhash

    ones, count, words = np.zeros(64, np.int64), 0, []
    for piece in pieces(text or b"", at_once):
        words = words[1 - width :] if len(words) >= width else words
        words += piece.lower().split()
        if len(words) < width:
            continue
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        shingles = [joined[a:b] for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())]
        hashes = np.array(list(map(xxhash.xxh64_intdigest, shingles, repeat(seed))), "<u8")
        for at in range(0, len(hashes), 1 << 15):
            ones += np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        count += len(hashes)
    if not count:
        return xxhash.xxh64_intdigest(b" ".join(words), seed) if words else 0
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *extra) -> DataFrame:
    """doc_id, any ``extra`` columns, and the fingerprint as a long, ``fp``. Null text counts as no words."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            values = np.array([fingerprint_of(t.as_py()) for t in batch.column(batch.num_columns - 1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(values)], names=[*batch.schema.names[:-1], "fp"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *extra, F.col("text").cast("binary").alias("text"))
    schema = narrow.select(*narrow.columns[:-1]).schema.add("fp", "long")
    return narrow.mapInArrow(tidy(run), schema)


def segments(blocks: int) -> list[tuple[int, int]]:
    """(shift, bits) of ``blocks`` near-equal segments of 64 bits."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def blocks_for(count: int, distance: int = 4) -> int:
    """The least number of segments whose agreeing bits tell ``count`` fingerprints apart; 12 at most."""
    return next((b for b in range(distance + 2, 12) if 64 * (b - distance) // b >= math.log2(count + 1) + 1), 12)


def links(fps: DataFrame, distance: int = 4, blocks: int = 6, dense: int = 64) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of ``fps`` within ``distance`` bits."""
    segs = segments(blocks)
    part = lambda fp: [F.shiftrightunsigned(fp, s).bitwiseAND(F.lit((1 << n) - 1)) for s, n in segs]
    own = part("fp")
    cells = []
    for k, same in enumerate(combinations(range(blocks), blocks - distance)):
        rest = sum((F.bit_count(own[i]) for i in range(blocks) if i not in same), F.lit(0))
        at = F.floor(rest / (distance + 1)).cast("int")
        for step in (0, 1):  # ranges of twice the width, so that near counts share one
            cells.append(F.xxhash64(F.lit(k), at + step, *[own[i] for i in same]))
    keyed = fps.select("fp", F.explode(F.array(*cells)).alias("cell"))
    sizes = keyed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    placed = materialize(keyed.join(sizes.hint("merge"), "cell"))

    cold = placed.where(F.col("n") <= dense)
    a, b = cold.select("cell", F.col("fp").alias("a")), cold.select("cell", F.col("fp").alias("b"))
    manhattan = sum((F.abs(F.bit_count(x) - F.bit_count(y)) for x, y in zip(part("a"), part("b"))), F.lit(0))
    near = a.join(b.hint("merge"), "cell").where("a > b").where(manhattan <= distance).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)

    masks = F.array(F.lit(0).cast("long"))  # all points within half the distance of zero
    for _ in range(distance // 2):
        masks = F.array_distinct(F.flatten(F.transform(masks, lambda m: F.concat(F.array(m), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))))))
    hot = placed.where(F.col("n") > dense).select("fp").distinct()
    balls = hot.select("fp", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("point"))
    least = balls.groupBy("point").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    star = balls.join(least.hint("merge"), "point").where("fp <> b").select(F.col("fp").alias("a"), "b")
    return near.select("a", "b").unionByName(star).distinct()


def near_duplicates(docs: DataFrame, distance: int = 4, *extra) -> DataFrame:
    """One row per document: doc_id, ``extra``, fp, component_id, the least doc_id that links reach, and component.

    ``component`` names the group even where all of its ids are null, and component_id with them. Texts without words
    share fingerprint zero and so link. Repeated rows link with each other. Long texts are hashed a MB at a time.
    Other columns are ignored. An empty table gives no rows.
    """
    prints = materialize(fingerprints(docs, *extra))
    per_fp = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = materialize(components(links(per_fp.select("fp"), distance, blocks_for(per_fp.count(), distance))))
    # only linked fingerprints need a component; any other stands for itself
    of = found.withColumnRenamed("node", "fp")
    ids = per_fp.join(of.hint("merge"), "fp").groupBy("component").agg(F.min("least").alias("component_id"))
    linked = of.join(ids.hint("merge"), "component").select("fp", "component_id", "component")
    every = per_fp.join(linked.hint("merge"), "fp", "left").select("fp", F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("component", "fp").alias("component"))
    return prints.join(every.hint("merge"), "fp")


def one_of_each(docs: DataFrame, distance: int = 4) -> DataFrame:
    """One document of each group of near duplicates, in all its columns: that with the least id.

    A row without an id stays only for a group in which no row has one; of several, and of several texts with one
    id, the one with the least text hash stands, and of repeated rows any one.
    """
    text = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    id_ = F.col("doc_id").cast("long")
    groups = near_duplicates(docs, distance, text.alias("text_hash"))
    heads = groups.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("d"), F.col("text_hash").alias("t"))).alias("head")).select("head.*").distinct()
    rows = docs.select(boxed(docs).alias("row"), id_.isNull().alias("none"), F.coalesce(id_, F.lit(0)).alias("d"), text.alias("t"))
    one = Window.partitionBy("none", "d", "t").orderBy("d")
    kept = rows.join(heads.hint("merge"), ["none", "d", "t"], "left_semi").withColumn("n", F.row_number().over(one)).where("n = 1")
    return kept.select(*unboxed(docs))


def op8_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
