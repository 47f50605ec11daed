"""Ledger, routing, snapshots, tenancy and limits: state as folds over events, change as anti-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from ..functions.keys import derived_file


def first_wins(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Insert if absent: the first row of a key stays, repeats are silent."""
    every = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*every), order).alias("r")).select(*key, "r.*")


def insert_new(table: DataFrame, rows: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """Rows whose key is not there; with ``order`` only the first of those that bring the same key, as if they came one by one."""
    new = rows.join(table.select(key), key, "left_anti")
    return new if order is None else first_wins(new, key, order).select(rows.columns)


def insert_together(table: DataFrame, rows: DataFrame, key: list[str], batch: str) -> DataFrame:
    """Rows of batches, each of which is inserted as a whole or, if a key of it is there or comes in two of its rows, not at all."""
    there = rows.join(table.select(key), key, "left_semi").select(batch)
    twice = rows.groupBy(batch, *key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(batch)
    return rows.join(there.unionByName(twice).distinct(), batch, "left_anti").select(rows.columns)


def held(table: DataFrame, wanted: DataFrame, key: list[str]) -> DataFrame:
    """The rows whose key is in ``wanted``, each once however often it is there: what is built of what is listed."""
    return table.join(wanted.select(key), key, "left_semi")


def without(table: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    """Delete, cleanup and cascade: what is not in ``gone``; a key that is missing is fine."""
    return table.join(gone.select(key).distinct(), key, "left_anti")


def update(current: DataFrame, rows: DataFrame, key: list[str], replace: bool = False) -> DataFrame:
    """``current`` updated by ``rows``, one a key: merged, what is null or not sent stays; with ``replace`` nothing stays.

    Rows whose key is not there change nothing.
    """
    sent = [c for c in rows.columns if c not in key]
    joined = current.join(rows.select(*key, *(F.col(c).alias(f"_{c}") for c in sent), F.lit(True).alias("_sent")), key, "left")

    def value(c):
        if c in key:
            return F.col(c)
        new = F.col(f"_{c}") if c in sent else F.lit(None)
        return (F.when(F.col("_sent"), new).otherwise(F.col(c)) if replace else F.coalesce(new, F.col(c))).alias(c)

    return joined.select(*map(value, current.columns))


def in_one(*kinds: DataFrame) -> DataFrame:
    """Rows of several kinds as one table, for one write; what a kind lacks is null."""
    out = kinds[0]
    for k in kinds[1:]:
        out = out.unionByName(k, allowMissingColumns=True)
    return out


def fold_ledger(events: DataFrame, key: list[str]) -> DataFrame:
    """One row per recorded action: times of record, last send and confirmation, and who has done it, first come first.

    ``events``: key, seq, event (recorded, sent, confirmed, done), occurred_at, subscriber. Without a record
    there is no action, and only the first record counts. An action has few subscribers.
    """
    at = lambda kind, pick: pick(F.when(F.col("event") == kind, F.struct("seq", "occurred_at")))["occurred_at"]
    ends = events.where("event = 'done'").groupBy(*key, "subscriber").agg(F.min("seq").alias("_first"))
    done = ends.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("_first", "subscriber"))), lambda x: x["subscriber"]).alias("done_by"))
    out = events.groupBy(*key).agg(at("recorded", F.min).alias("recorded_at"), at("sent", F.max).alias("sent_at"), at("confirmed", F.max).alias("confirmed_at"))
    out = out.where("recorded_at is not null").join(done, key, "left").withColumn("done_by", F.coalesce("done_by", F.array().cast("array<string>")))
    return out.withColumn("last_sent_at", F.coalesce("sent_at", "recorded_at")).drop("sent_at")


def resendable(ledger: DataFrame, unconfirmed_before: Column, confirmed_before: Column) -> DataFrame:
    """Nobody is done, and the last send is old enough: less so if it was never confirmed."""
    weak = F.col("last_sent_at") <= F.greatest(unconfirmed_before, confirmed_before)  # this much a scan can use
    exact = F.col("last_sent_at") <= F.when(F.col("confirmed_at").isNull(), unconfirmed_before).otherwise(confirmed_before)
    return ledger.where(weak).where((F.size("done_by") == 0) & exact)


def expired(ledger: DataFrame, cutoff: Column) -> DataFrame:
    return ledger.where((F.col("recorded_at") <= cutoff) & (F.size("done_by") > 0))


def start_up(ledger: DataFrame, now: Column, done_life: Column, unconfirmed: Column, confirmed: Column) -> tuple[DataFrame, DataFrame]:
    """(the ledger without finished rows that have expired, the rows of it to send again): in this order, once a start."""
    over = F.coalesce((F.col("recorded_at") <= now - done_life) & (F.size("done_by") > 0), F.lit(False))
    kept = ledger.where(~over)
    return kept, resendable(kept, now - unconfirmed, now - confirmed)


def trace_link(parent: Column) -> Column:
    """The trace that a resent action links to: its recording's, or none if that is not a valid one."""
    return F.when(parent.rlike(r"\A[0-9a-f]{2}-(?!0{32})[0-9a-f]{32}-(?!0{16})[0-9a-f]{16}-[0-9a-f]{2}\z"), parent)


def returned(dead: DataFrame, now: Column, delay: Column) -> tuple[DataFrame, DataFrame]:
    """(what has waited ``delay`` since ``died_at`` and goes back to its own queue, what still waits)."""
    due = F.col("died_at") + delay <= now
    return dead.where(due), dead.where(~due)


def retry_budget(delay_seconds: int, limit: int, expiry_seconds: int) -> int:
    """Seconds that all retries take; as long as the expiry or longer is an error."""
    if (took := delay_seconds * limit) >= expiry_seconds:
        raise ValueError(f"{limit} retries of {delay_seconds} s do not end before {expiry_seconds} s")
    return took


def pending(deliveries: DataFrame, ledger: DataFrame, key: list[str]) -> DataFrame:
    """Deliveries whose action exists and which their subscriber has not done."""
    return deliveries.join(ledger.select(*key, "done_by"), key).where(~F.array_contains("done_by", F.col("subscriber"))).drop("done_by")


def route(messages: DataFrame, bindings: DataFrame, key: str, parking: str = "parking") -> DataFrame:
    """Each message once for every queue bound to its key; without one it is parked."""
    return messages.join(bindings, key, "left").withColumn("queue", F.coalesce("queue", F.lit(parking)))


def delivery_fate(cycles: Column, limit: int, readable: Column) -> Column:
    """More cycles than the limit parks, before the body is read; then an unreadable body fails."""
    return F.when(cycles > limit, "park").when(~readable, "fail").otherwise("run")


def retry_cycles(deaths: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(deaths, lambda d: d["count"])), F.lit(0))


def snapshot_diff(a: DataFrame, b: DataFrame, key: str, tag: str) -> DataFrame:
    """Keys that differ between two snapshots; none means that they are the same."""
    x, y = a.select(key, F.col(tag).alias("before")), b.select(key, F.col(tag).alias("after"))
    return x.join(y, key, "full_outer").where(~F.col("before").eqNullSafe(F.col("after")))


def first_per_group(rows: DataFrame, group: list[str], order: str) -> DataFrame:
    """The first row of each group in an explicit order: of failing items, the one that an error names."""
    rest = [c for c in rows.columns if c not in group]
    return rows.groupBy(*group).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*group, "_r.*")


def missing_files(refined: DataFrame, files: DataFrame, kind: str, name: str = "name") -> DataFrame:
    """Refined chapters without their plan or summary file."""
    return refined.withColumn("_want", derived_file(F.col(name), kind)).join(files.select(F.col(name).alias("_want")), "_want", "left_anti").drop("_want")


def next_position(children: DataFrame, families: DataFrame, key: str, position: str) -> DataFrame:
    """One past the greatest position, deleting children included; 0 for a family without any."""
    most = children.groupBy(key).agg(F.max(position).alias("_m"))
    return families.select(key).join(most, key, "left").select(key, (F.coalesce("_m", F.lit(-1)) + 1).cast("long").alias("next_position"))


def fixed_window(events: DataFrame, key: str, ts: str, order: str, unit: str, limit: int) -> DataFrame:
    """Whether each event is admitted: the first ``limit`` of its key in each epoch-aligned ``unit``."""
    w = Window.partitionBy(key, F.date_trunc(unit, ts)).orderBy(order)
    return events.withColumn("admitted", F.row_number().over(w) <= limit)


def used_window(events: DataFrame, key: str, ts: str, order: str, seconds: int, permits: int) -> DataFrame:
    """Whether each event is admitted: the first ``permits`` of its key in each window, which starts at its first use.

    The next window of a key starts with the first event ``seconds`` after the start of the last. Events of a key
    come in ``order``; time never goes back, so one that seems earlier than those before counts as late as they, as does one without a
    time. A window that such a one starts has no end.
    """
    return chained_limits(events, key, ts, order, [(seconds, permits)])


def chained_limits(events: DataFrame, key: str, ts: str, order: str, rules: list[tuple[int, int]]) -> DataFrame:
    """Whether all rules (seconds, permits) admit each event of a key; windows are those of ``used_window``.

    A rule in turn that admits keeps the permit even if a later one refuses, and a later one only sees what the earlier admit.
    Events are dealt by key and read in order, once for all rules: a task holds a start and a count for each rule of the key that it is at.
    """

    def run(batches):
        import pyarrow as pa

        at, ends, used = None, None, None
        for b in batches:
            admitted = []
            for k, t in zip(b.column(len(b.columns) - 2).to_pylist(), b.column(len(b.columns) - 1).to_pylist()):
                if ends is None or k != at:
                    at, ends, used = k, [float("-inf")] * len(rules), [0] * len(rules)
                ok = True
                for i, (seconds, permits) in enumerate(rules):
                    if not used[i] or t is not None and t >= ends[i]:
                        ends[i], used[i] = float("inf") if t is None else t + seconds * 1_000_000, 0
                    used[i] += 1
                    if used[i] > permits:
                        ok = False
                        break
                admitted.append(ok)
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(admitted, pa.bool_())], names=[*b.schema.names[:-2], "admitted"])

    dealt = events.withColumns({"_key": F.col(key), "_us": F.unix_micros(F.col(ts).cast("timestamp"))}).repartition("_key").sortWithinPartitions("_key", order)
    return dealt.mapInArrow(run, StructType([*events.schema.fields, StructField("admitted", BooleanType())]))
