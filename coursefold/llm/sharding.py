"""Operator 7: a hierarchical weighted hash tree that deals documents to shards.

Each document descends region, rack and shard. At a node every child draws
``-ln(u) / weight`` with ``u`` hashed from the document's key and the child's name, and the least
draw wins, so a child is chosen with a probability in proportion to its weight. A draw depends on
nothing but key, child and weight: if one weight grows, keys can only move into that child's
subtree. All of it is column arithmetic on one narrow projection.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table


@dataclass(frozen=True)
class Node:
    """A subtree: ``children`` for regions and racks, ``shard`` for a leaf."""

    name: str
    weight: float = 1.0
    children: tuple[Node, ...] = field(default=())
    shard: int | None = None


def branch(name: str, children: list[Node]) -> Node:
    """A node whose weight is the sum of its children's."""
    return Node(name, sum(c.weight for c in children), tuple(children))


def tree(shards: int, base: int = 16, racks: int = 2, per_rack: int = 4) -> Node:
    """The tree for a shard count: the first ``base`` shards fill regions of ``racks`` racks.

    Every shard past ``base`` is a region of its own. As no older subtree changes its weight, a
    further shard takes documents only into itself.
    """

    def leaf(i: int) -> Node:
        return Node(f"s{i}", 1.0, (), i)

    filled = min(shards, base)
    regions = []
    for r, first in enumerate(range(0, filled, racks * per_rack)):
        own = range(first, min(filled, first + racks * per_rack))
        regions.append(branch(f"region{r}", [branch(f"region{r}/rack{k}", [leaf(i) for i in own[k * per_rack : (k + 1) * per_rack]]) for k in range(-(-len(own) // per_rack))]))
    regions += [branch(f"region+{i}", [branch(f"region+{i}/rack0", [leaf(i)])]) for i in range(base, shards)]
    return branch("root", regions)


def _draw(key: Column, child: Node) -> Column:
    # 52 bits of the hash, moved off zero, are a uniform number in (0, 1)
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(child.name)), 12).cast("double") + 0.5) / float(1 << 52)
    return -F.ln(u) / F.lit(float(child.weight))


def descend(key: Column, node: Node) -> Column:
    """The shard that ``key`` reaches below ``node``."""
    if node.shard is not None:
        return F.lit(node.shard)
    children = [c for c in node.children if c.weight > 0]
    if len(children) == 1:
        return descend(key, children[0])
    best = F.array_min(F.array(*[F.struct(_draw(key, c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(children)]))["i"]
    choice = descend(key, children[-1])
    for i, c in reversed(list(enumerate(children[:-1]))):
        choice = F.when(best == i, descend(key, c)).otherwise(choice)
    return choice


def shard_documents(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, size, text_crc32, shard, slot and grown_shard.

    Size is the text's UTF-8 bytes plus 1; a null text has no bytes and the CRC of none. A null key
    is a key like any other. Repeated rows each get a slot. Slots number a shard's rows from 0
    without gaps: numbers within an input partition plus the rows of the partitions before it, so no
    task holds a shard. An empty table gives no rows; further columns are ignored.
    """
    k = F.coalesce(F.col(key).cast("string"), F.lit("\u0000"))
    body = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        descend(k, tree(shards)).alias("shard"),
        descend(k, tree(shards + 1)).alias("grown_shard"),
        F.monotonically_increasing_id().alias("_row"),
    )
    base = materialize(base)  # row numbers must not change between the two uses below
    # some ten thousand consecutive rows at most share a piece, however large the partition
    piece = F.shiftright("_row", 14).alias("_piece")
    counts = base.groupBy("shard", piece).agg(F.count(F.lit(1)).alias("n"))
    # pieces are summed in two levels, so that a window holds thousands of counts and not all
    upper = F.shiftright("_piece", 12)
    tops = counts.groupBy("shard", upper.alias("_top")).agg(F.sum("n").alias("n"))
    tops = tops.select("shard", "_top", (F.sum("n").over(Window.partitionBy("shard").orderBy("_top")) - F.col("n")).alias("_before"))
    inner = Window.partitionBy("shard", "_top").orderBy("_piece")
    starts = counts.withColumn("_top", upper).join(tops, ["shard", "_top"]).select("shard", "_piece", (F.col("_before") + F.sum("n").over(inner) - F.col("n")).alias("_start"))
    rank = F.row_number().over(Window.partitionBy("shard", "_piece").orderBy("_row")) - 1
    numbered = base.withColumn("_piece", F.shiftright("_row", 14)).withColumn("_rank", rank)
    return numbered.join(starts, ["shard", "_piece"]).select("doc_id", "size", "text_crc32", "shard", (F.col("_start") + F.col("_rank")).cast("long").alias("slot"), "grown_shard")


def op7_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int"), "slot", F.col("grown_shard").cast("int"))
