"""Streams with keyed state: the progress fold, deliveries done once, the delay queue, screen visits and changes.

Each is a processor that holds what a key needs to go on with and nothing of the log. State lies in the state store and comes back from
the checkpoint, so a stream that was stopped goes on where it was. Within a micro-batch the rows of a key come in any order and
are sorted by their sequence; batches come in order.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from ..functions.text import chapter_state
from ..operators.fold import CHAPTER
from ..sources.written import scratch

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state_store(spark: SparkSession) -> None:
    """The store that keyed state with several variables and timers needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def _run(rows: DataFrame, key: list[str], processor: StatefulProcessor, output: str | StructType, mode: str, time: str) -> DataFrame:
    with_state_store(rows.sparkSession)
    return rows.groupBy(*key).transformWithState(statefulProcessor=processor, outputStructType=output, outputMode=mode, timeMode=time)


class Fold(StatefulProcessor):
    """The progress fold's rules on one chapter: an attempt's plan, its done concepts and taken checks, and the totals."""

    STATE = "plan string, attempts long, concepts long, done array<string>, taken array<string>, checks long, right_count long, of_count long, last_activity {at}"

    def __init__(self, key: list[str], at: str):
        self.key, self.at = key, at

    def init(self, handle) -> None:
        self.chapter = handle.getValueState("chapter", self.STATE.format(at=self.at))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        old = self.chapter.get() if self.chapter.exists() else None
        s = list(old) if old is not None else None
        changed = False
        for r in sorted(rows, key=lambda r: r.seq):
            if r.kind == "plan":
                if s and s[0] == r.plan_id:
                    continue
                totals = s[1:2] + s[5:8] if s else [0, 0, None, None]
                s = [r.plan_id, totals[0] + 1, r.concept_count, [], [], *totals[1:], r.occurred_at]
            elif s is None:
                continue
            elif r.kind == "concept":
                if r.concept_id in s[3] or s[2] is None or len(s[3]) >= s[2]:
                    continue
                s[3], s[8] = [*s[3], r.concept_id], r.occurred_at
            elif r.kind == "check":
                if not r.of_count or r.of_count < 0 or r.check_id in s[4]:
                    continue
                s[4], s[5:9] = [*s[4], r.check_id], [s[5] + 1, r.right_count, r.of_count, r.occurred_at]
            else:
                continue
            changed = True
        if changed:
            self.chapter.update(tuple(s))
            yield Row(**dict(zip(self.key, key)), attempt_count=s[1], concept_count=s[2], concepts_done=len(s[3]), latest_checks=len(s[4]), check_count=s[5], latest_right=s[6], latest_of=s[7], last_activity=s[8])

    def close(self) -> None:
        pass


def fold_stream(events: DataFrame, chapter: list[str] = CHAPTER) -> DataFrame:
    """A stream of chapters' summaries, a new row for each chapter that a batch changes, from a stream of progress events.

    Columns as ``operators.fold.summaries``. The store holds a chapter's totals and the ids of its latest attempt; no event is read again.
    """
    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    keys = ", ".join(f"{c} {kinds[c]}" for c in chapter)
    out = f"{keys}, attempt_count long, concept_count long, concepts_done long, latest_checks long, check_count long, latest_right long, latest_of long, last_activity {kinds['occurred_at']}"
    rows = _run(events, chapter, Fold(chapter, kinds["occurred_at"]), out, "Update", "None")
    return rows.withColumn("state", chapter_state(F.col("latest_checks"), F.col("concepts_done"), F.coalesce("concept_count", F.lit(0))))


class Once(StatefulProcessor):
    """Whether a subscriber has had an action: a mark that goes after its time."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle) -> None:
        self.done = handle.getValueState("done", "at boolean", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        first = next(iter(rows))
        for _ in rows:  # what else came in this batch is a repeat
            pass
        if not self.done.exists():
            self.done.update((True,))
            yield first

    def close(self) -> None:
        pass


def once(deliveries: DataFrame, key: list[str], keep_ms: int | None = None) -> DataFrame:
    """A stream of each key's first delivery: subscriber and action. Marks go after ``keep_ms``, longer than a delivery can come again.

    The mark is committed with the batch that hands the delivery on, so a batch that fails hands it on again. Marks without an end are Spark's own
    ``dropDuplicates``, which asks the store for all rows of a task without a call to Python for each. With ``keep_ms`` the clock makes batches
    of its own: such a stream runs on a trigger by time until it is stopped, and never ends as one over what is available now.
    """
    if keep_ms is None:
        with_state_store(deliveries.sparkSession)
        return deliveries.dropDuplicates(key)
    return _run(deliveries, key, Once(keep_ms), deliveries.schema, "Append", "ProcessingTime")


class Delay(StatefulProcessor):
    """Deliveries that failed about the same time and wait: each with the time at which it goes back. One timer is for the first of them."""

    def __init__(self, columns: list[str], schema: str, delay_ms: int, by_event: bool):
        self.columns, self.schema, self.delay_ms, self.by_event = columns, schema, delay_ms, by_event

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"_due long, {self.schema}")
        self.timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        came = [(r["_died"] + self.delay_ms, *(r[c] for c in self.columns)) for r in rows]
        self.waiting.appendList(came)
        first = min(r[0] for r in came)
        old = self.timer.get()[0] if self.timer.exists() else None
        if old is None or first < old:
            if old is not None:
                self.handle.deleteTimer(old)
            self.wake(first)
        return iter(())

    def wake(self, at: int) -> None:
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() if self.by_event else timerValues.getCurrentProcessingTimeInMs()
        ready, later = [], []
        for r in map(tuple, self.waiting.get()):
            (ready if r[0] < now else later).append(r)
        if later:
            self.waiting.put(later)
            self.wake(min(r[0] for r in later))
        else:
            self.waiting.clear()
            self.timer.clear()
        for r in ready:
            row = dict(zip(self.columns, r[1:]))
            row["cycles"] += 1
            yield Row(**row)

    def close(self) -> None:
        pass


def delayed(failed: DataFrame, key: list[str], delay_ms: int, at: str | None = None, slots: int = 8) -> DataFrame:
    """A stream of failed deliveries that have waited ``delay_ms``, with ``cycles`` one higher: they go back to their own ``queue``.

    ``failed`` has the ``key`` (queue and action), ``cycles`` and what else a delivery holds. Waiting ones are in the store in one list with one timer
    for each eighth of the delay and each of ``slots`` hashes of the key, so a batch touches few lists.
    The wait starts when a row's batch does or, with ``at``, at that time of the row, and then ends when the watermark passes its end. Without ``at``
    the clock makes batches of its own: run it on a trigger by time.
    """
    kinds = [(f.name, f.dataType.simpleString()) for f in failed.schema.fields]
    schema = ", ".join(f"{c} {t}" for c, t in kinds)
    processor = Delay([c for c, _ in kinds], schema, delay_ms, at is not None)
    now = F.unix_millis(F.current_timestamp())
    failed = failed.withColumn("_died", F.coalesce(F.unix_millis(F.col(at).cast("timestamp")), now) if at else now)
    failed = failed.withColumn("_span", F.floor(F.col("_died") / max(1, delay_ms // 8))).withColumn("_slot", F.pmod(F.xxhash64(*key), F.lit(slots)))
    return _run(failed, ["_span", "_slot"], processor, schema, "Append", "EventTime" if at else "ProcessingTime")


class Visits(StatefulProcessor):
    """Screens' visits: whether each listens, and where its running clock started. Markers wait until the watermark has passed them and all before them.

    With ``key``, a column, the markers of many screens wait in one list with one timer, and each screen has a visit of its own.
    What waits lies in blocks with an array for each column, as the store is asked at some cost for each row of its own.
    """

    BLOCK = 5_000

    def __init__(self, names: list[str], schema: str, order: str, event: str, key: str | None = None):
        self.names, self.schema, self.key = names, schema, key
        self.order, self.event, self.us = (names.index(c) for c in (order, event, "_us"))
        self.screen = names.index(key) if key else None

    def init(self, handle) -> None:
        self.handle = handle
        kinds = re.fullmatch(", ".join(f"{re.escape(c)} (.+?)" for c in self.names), self.schema).groups()
        self.waiting = handle.getListState("waiting", ", ".join(f"{c} array<{t}>" for c, t in zip(self.names, kinds)))
        self.timer = handle.getValueState("timer", "at long")
        visit = f"listening boolean, running boolean, {self.schema}"
        self.visit = handle.getMapState("visit", f"{self.key} {kinds[self.screen]}", visit) if self.key else handle.getValueState("visit", visit)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        came = [tuple(r[c] for c in self.names) for r in rows]
        self.waiting.appendList(self.blocks(came))
        first = min(map(self.due, came))
        old = self.timer.get()[0] if self.timer.exists() else None
        if old is None or first < old:
            if old is not None:
                self.handle.deleteTimer(old)
            self.wake(first)
        return iter(())

    def blocks(self, markers: list[tuple]) -> list[tuple]:
        return [tuple(map(list, zip(*markers[n : n + self.BLOCK]))) for n in range(0, len(markers), self.BLOCK)]

    def due(self, marker: tuple) -> int:
        """The first millisecond of the watermark at which nothing can come before a marker any more."""
        return marker[self.us] // 1000 + 1

    def wake(self, at: int) -> None:
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        screens, later, wakes = {}, [], []
        for block in self.waiting.get():
            for r in zip(*block):
                screens.setdefault(r[self.screen] if self.key else None, []).append(r)
        for screen, markers in screens.items():
            markers.sort(key=lambda r: r[self.order])
            n = next((n for n, r in enumerate(markers) if self.due(r) > now), len(markers))
            if n:
                yield from self.ended(screen, markers[:n])
            if n < len(markers):
                later += markers[n:]
                wakes.append(self.due(markers[n]))
        if later:
            self.waiting.put(self.blocks(later))
            self.wake(min(wakes))
        else:
            self.waiting.clear()
            self.timer.clear()

    def ended(self, screen, markers: list[tuple]) -> Iterator[Row]:
        """The stretches that a screen's next markers end."""
        if self.key:
            old = self.visit.getValue((screen,))
        else:
            old = self.visit.get() if self.visit.exists() else None
        listening, running, *start = tuple(old) if old is not None else (False, False)
        for r in markers:
            kind = r[self.event]
            if running and kind in ("view", "leave", "background"):
                us = r[self.us] - start[self.us]  # below zero where times go back
                yield Row(**dict(zip(self.names, start)), viewed=start[self.event] == "view", seconds=(abs(us) + 500_000) // 1_000_000 * (1 if us > 0 else -1))
                running = False
            if kind == "view" or kind == "foreground" and listening and not running:
                running, start = True, r
            listening = kind == "view" or listening and kind != "leave"
        new = (listening, running, *(start or (None,) * len(self.names)))
        if self.key:
            self.visit.updateValue((screen,), new)
        else:
            self.visit.update(new)

    def close(self) -> None:
        pass


def screen_stream(markers: DataFrame, key: str, order: str, ts: str, event: str = "event", slots: int = 256) -> DataFrame:
    """A stream of ended stretches as ``operators.timeline.screen_times`` gives them; ``markers`` has a watermark on ``ts``.

    Markers may come late by as much as the watermark allows: they wait in the store until it has passed them, in one list with one timer for each
    of ``slots`` hashes of the key, so a batch asks the store for few lists. A stretch that is still open when the stream is stopped stays in the store.
    """
    kinds = {f.name: f.dataType.simpleString() for f in markers.schema.fields}
    held = {c: t for c, t in kinds.items() if c != ts} | {"_us": "bigint"}  # the time itself is made again from its microseconds
    schema = ", ".join(f"{c} {t}" for c, t in held.items())
    slotted = markers.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn("_slot", F.pmod(F.xxhash64(key), F.lit(slots)))
    out = _run(slotted, ["_slot"], Visits(list(held), schema, order, event, key), f"{schema}, viewed boolean, seconds long", "Append", "EventTime")
    return out.withColumn(ts, F.timestamp_micros("_us").cast(kinds[ts])).select(*kinds, "viewed", "seconds")


class Changes(StatefulProcessor):
    """The last value of a key that was polled."""

    def __init__(self, order: str, value: str, kind: str):
        self.order, self.value, self.kind = order, value, kind

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", f"seen boolean, value {self.kind}")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        seen, last = tuple(self.last.get()) if self.last.exists() else (False, None)
        for r in sorted(rows, key=lambda r: r[self.order]):
            if not seen or r[self.value] != last:
                yield r
            seen, last = True, r[self.value]
        self.last.update((seen, last))

    def close(self) -> None:
        pass


def change_stream(polls: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """A stream of the polls whose value is not that of the key's poll before, over all batches; the first of a key is one."""
    kind = polls.schema[value].dataType.simpleString()
    return _run(polls, [key], Changes(order, value, kind), polls.schema, "Append", "None")


def _steps(rows: DataFrame, order: str, slices: int) -> tuple[int | None, int]:
    """Where the first of ``slices`` starts and how far each goes."""
    low, high = rows.agg(F.min(order), F.max(order)).first()
    return low, (high - low) // slices + 1 if low is not None else 1


def late_by(rows: DataFrame, order: str, slices: int, ts: str) -> int:
    """Seconds by which ``ts`` of a row of ``in_slices`` is before that of a row of an earlier slice, at most: its watermark has to allow more."""
    low, step = _steps(rows, order, slices)
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    times = rows.where(F.col(order).isNotNull()).groupBy(F.expr(f"({order} - {low or 0}) div {step}").alias("k")).agg(F.min(us).alias("first"), F.max(us).alias("last"))
    newest, late = None, 0
    for k in times.where("first IS NOT NULL").orderBy("k").collect():
        late = max(late, newest - k["first"]) if newest is not None else 0
        newest = max(newest, k["last"]) if newest is not None else k["last"]
    return -(-late // 1_000_000)


def in_slices(rows: DataFrame, order: str, slices: int, build: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    """What ``build``'s stream gives for ``rows`` that come in ``slices`` by ``order``, one after the other, with the ``batch`` that gave it.

    Each slice is a run of its own that goes on from the checkpoint of the one before and ends when it has read what is there, as a scheduled
    job does. A batch overwrites its own output, so one that is run again adds nothing.
    """
    spark, folder = rows.sparkSession, scratch(rows.sparkSession)
    low, step = _steps(rows, order, slices)

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    for k in range(slices):
        at = F.lit(low).cast("long") + k * step
        rows.where((F.col(order) >= at) & (F.col(order) < at + step)).write.parquet(f"{folder}/in/{k}")
        stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).parquet(f"{folder}/in")
        run = build(stream).writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    schema = build(spark.readStream.schema(rows.schema).parquet(f"{folder}/in")).schema
    return spark.read.schema(schema.add("batch", "long")).option("basePath", f"{folder}/out").parquet(f"{folder}/out")


def newest(versions: DataFrame, key: list[str], version: Column) -> DataFrame:
    """Each key's row of the newest version, of what an updating stream has appended."""
    rest = [c for c in versions.columns if c not in key]
    return versions.groupBy(*key).agg(F.max_by(F.struct(*rest), version).alias("_r")).select(*key, "_r.*")
