"""Chains of pointers, followed in rounds that double their length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.written import materialize


def reachable(pointers: DataFrame, roots: DataFrame, key: list[str], id_: str = "id", to: str = "next") -> DataFrame:
    """(key, id) of all rows that chains of ``pointers`` (key, id, next) reach from ``roots``, which are among them.

    A row points to at most one other, and no row is reached from two roots. After k rounds all rows within 2**k steps are found, so
    there are about as many rounds as the longest chain has binary digits. Each is two joins, on key and id together, so a key with very
    many rows is spread. Roots that point nowhere are their own chain.
    """
    jump = materialize(pointers.where(F.col(id_).isNotNull() & F.col(to).isNotNull()).select(*key, id_, to))
    found = materialize(roots.select(*key, id_))
    while True:
        new = materialize(found.join(jump, [*key, id_]).select(*key, F.col(to).alias(id_)))
        if new.isEmpty():
            return found
        found = found.unionByName(new)
        after = jump.select(*key, F.col(id_).alias(to), F.col(to).alias("_then"))
        jump = materialize(jump.join(after, [*key, to]).select(*key, id_, F.col("_then").alias(to)))
