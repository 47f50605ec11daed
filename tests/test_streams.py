"""Streams with keyed state: stopped and started again, with late rows, and around the delay queue."""

import random
import time
from datetime import datetime, timedelta

from pyspark.sql import Row
from pyspark.sql import functions as F

from coursefold.operators import timeline
from coursefold.plans import queries, stream_queries
from coursefold.streaming import stateful
from test_operators import COLUMNS, EVENT, direct, random_events


def test_fold_goes_on_from_its_checkpoint(spark):
    events = random_events(600, 11)
    out = stateful.in_slices(spark.createDataFrame(events, EVENT), "seq", 3, stateful.fold_stream, "update")
    assert out.select("batch").distinct().count() >= 3
    chapter = ["family_id", "child_id", "class_level", "chapter_id"]
    got = {tuple(r) for r in stateful.newest(out, chapter, F.col("batch")).select(COLUMNS).collect()}
    assert got == direct(events)


def test_screens(spark):
    rng = random.Random(4)
    kinds = ["view", "leave", "background", "foreground"]
    rows, t = [], 0
    for n in range(240):
        t += rng.choice([1, 2, 30])
        rows.append((rng.randrange(4), n, t, rng.choice(kinds)))

    def plain(rows):
        out, state = {}, {}
        for k, n, at, kind in rows:
            listening, start = state.get(k, (False, None))
            if kind == "foreground":
                start = (n, at, False) if listening and start is None else start
            else:
                if start:
                    out[start[0]] = (k, start[2], at - start[1])
                start = (n, at, True) if kind == "view" else None
                listening = kind == "view" or listening and kind == "background"
            state[k] = (listening, start)
        return out, {s[0]: (k, s[2], None) for k, (_, s) in state.items() if s}

    ended, still_open = plain(rows)
    df = spark.createDataFrame(rows, "k int, n int, s int, event string").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.n: (r.k, r.viewed, r.seconds) for r in timeline.screen_times(df, "k", "n", "ts").collect()}
    assert got == ended | still_open
    probe = [(1, 0, 0, "view"), (1, 1, 5, "foreground"), (1, 2, 10, "leave"), (1, 3, 20, "foreground"), (1, 4, 29, "view")]
    assert plain(probe) == ({0: (1, True, 10)}, {4: (1, True, None)})
    # rows come late by up to 60 seconds: slices by a shuffled order
    late = [(*r, r[2] // 50 * 100 + rng.randrange(60)) for r in rows] + [(-1, 10**6, 10**6, "background", 10**6)]
    stream = spark.createDataFrame(late, "k int, n int, s int, event string, came int").withColumn("ts", F.timestamp_seconds("s"))
    out = stateful.in_slices(stream, "came", 3, lambda s: stateful.screen_stream(s.withWatermark("ts", "10 minutes"), "k", "n", "ts"))
    assert {r.n: (r.k, r.viewed, r.seconds) for r in out.collect()} == ended


def test_once_and_changes(spark):
    rows = spark.createDataFrame([(n, n % 3, n % 7 // 3) for n in range(60)], "n int, k int, v int")
    out = stateful.in_slices(rows, "n", 2, lambda s: stateful.once(s, ["k", "v"]))
    assert sorted((r.k, r.v) for r in out.collect()) == sorted({(n % 3, n % 7 // 3) for n in range(60)})
    last, want = {}, []
    for n in range(60):
        if last.get(n % 3) != n % 7 // 3:
            want.append(n)
        last[n % 3] = n % 7 // 3
    assert sorted(r.n for r in stateful.in_slices(rows, "n", 2, lambda s: stateful.change_stream(s, "k", "n", "v")).collect()) == want


def test_marks_without_end_need_no_python(spark):
    stream = spark.readStream.format("rate").load()
    plan = lambda df: df._jdf.queryExecution().analyzed().toString()
    assert "TransformWithState" not in plan(stateful.once(stream, ["value"])) and "TransformWithState" in plan(stateful.once(stream, ["value"], 1000))


def test_failures_wait_and_come_back(spark, tmp_path):
    """Failing deliveries go round: to the delay queue, and back to their own queue with a cycle more, until they park."""
    schema, limit = "queue string, action string, cycles int, fails int", 2
    rows = [(f"s{n % 2}", f"a{n}", 0, n % 5) for n in range(10)]  # each works once it has failed so often
    work, failed, done, parked = (f"{tmp_path}/{d}" for d in ("work", "failed", "done", "parked"))
    for d in (work, failed):
        spark.createDataFrame([], schema).write.json(d)
    spark.createDataFrame(rows, schema).write.mode("append").json(work)

    def worker(batch, _):
        batch = batch.persist()
        park = F.col("cycles") > limit
        batch.where(park).write.mode("append").parquet(parked)
        batch.where(~park & (F.col("cycles") >= F.col("fails"))).write.mode("append").parquet(done)
        batch.where(~park & (F.col("cycles") < F.col("fails"))).write.mode("append").json(failed)
        batch.unpersist()

    def read(path):
        return spark.readStream.schema(schema).json(path)

    began = time.time()
    queries = [
        read(work).writeStream.foreachBatch(worker).option("checkpointLocation", f"{tmp_path}/c1").trigger(processingTime="1 second").start(),
        stateful.delayed(read(failed), ["queue", "action"], 1500).writeStream.foreachBatch(lambda b, _: b.write.mode("append").json(work)).option("checkpointLocation", f"{tmp_path}/c2").trigger(processingTime="1 second").start(),
    ]
    try:
        got = {}
        while time.time() - began < 150 and len(got) < len(rows) and not any(q.exception() for q in queries):
            time.sleep(2)
            for name, path in (("done", done), ("parked", parked)):
                try:
                    got |= {r.action: (name, r.queue, r.cycles) for r in spark.read.schema(schema).parquet(path).collect()}
                except Exception:  # nothing is there yet
                    pass
    finally:
        for q in queries:
            q.stop()
    assert got == {a: ("done", q, f) if f <= limit else ("parked", q, limit + 1) for q, a, _, f in rows}
    assert time.time() - began > 3 * 1.5


class Held:
    """One key's state and timers, kept in memory."""

    def __init__(self):
        self.cells, self.timers, self.set = {}, set(), 0

    def getValueState(self, name, schema):
        return self.Cell(self.cells, name)

    getListState = getValueState

    def registerTimer(self, at):
        self.timers.add(at)
        self.set += 1

    def deleteTimer(self, at):
        self.timers.remove(at)

    class Cell:
        def __init__(self, cells, name):
            self.cells, self.name = cells, name

        exists = lambda self: self.name in self.cells
        get = lambda self: self.cells[self.name]
        clear = lambda self: self.cells.pop(self.name, None)

        def update(self, value):
            self.cells[self.name] = value

        put = update

        def appendList(self, values):
            self.cells[self.name] = [*self.cells.get(self.name, []), *values]


def test_a_key_has_one_timer():
    """However many markers of a key wait, one timer is set, and what is due goes in one pass over them."""
    held, rng = Held(), random.Random(9)
    visits = stateful.Visits(["n", "event", "_us"], "n long, event string, _us long", "n", "event")
    visits.init(held)
    kinds = ["view", "leave", "background", "foreground"]
    markers = [Row(n=n, event=rng.choice(kinds), _us=n * 1_000_000 + rng.randrange(900_000)) for n in range(2000)]
    out, at, calls = [], 0, 0
    while at < len(markers) or held.timers:
        some = markers[at : at + 300]
        rng.shuffle(some)
        at += 300
        for half in (some[:150], some[150:]):
            if half:
                list(visits.handleInputRows((1,), iter(half), None))
                assert len(held.timers) == 1
        now = (at - 100) * 1000 if at < len(markers) else 10**10

        class Watermark:
            getCurrentWatermarkInMs = lambda self: now

        for t in [t for t in held.timers if t <= now]:
            held.timers.remove(t)
            out += visits.handleExpiredTimer((1,), Watermark(), None)
            calls += 1
    assert calls <= 9 and held.set <= 25 and "waiting" not in held.cells
    start, want, listening = None, [], False
    for m in markers:
        if start and m.event in ("view", "leave", "background"):
            want.append((start.n, start.event == "view", (m._us - start._us + 500_000) // 1_000_000))
            start = None
        if m.event == "view" or m.event == "foreground" and listening and not start:
            start = m
        listening = m.event == "view" or listening and m.event != "leave"
    assert [(r.n, r.viewed, r.seconds) for r in out] == want


def test_waiting_deliveries_share_a_timer():
    held, now = Held(), 0
    delay = stateful.Delay(["n", "cycles"], "n long, cycles int", 1000, True)
    delay.init(held)

    class Watermark:
        getCurrentWatermarkInMs = lambda self: now

    list(delay.handleInputRows((0, 0), iter([Row(n=n, cycles=0, _died=n) for n in range(500)]), None))
    assert held.timers == {1000}
    out = []
    for now in (1200, 5000):
        held.timers.clear()
        out.append([(r.n, r.cycles) for r in delay.handleExpiredTimer((0, 0), Watermark(), None)])
    assert out == [[(n, 1) for n in range(200)], [(n, 1) for n in range(200, 500)]] and not held.timers and not held.cells


def test_screens_of_a_slot_share_a_timer():
    """However many screens and markers a slot has, they wait in few blocks with one timer, and each screen is as if it were alone."""

    class Slot(Held):
        def getMapState(self, name, key, value):
            self.visits = {}

            class Visits:
                getValue = lambda _, k: self.visits.get(k)
                updateValue = lambda _, k, v: self.visits.update({k: v})

            return Visits()

    names, schema = ["k", "n", "event", "_us"], "k long, n long, event string, _us long"
    rng = random.Random(3)
    markers = [Row(k=rng.choice([None, *range(40)]), n=n, event=rng.choice(["view", "leave", "background", "foreground"]), _us=n * 1_000_000) for n in range(12_000)]

    def run(held, visits, rows):
        visits.init(held)
        out = []
        for part, now in ((rows[: len(rows) // 2], 4_000_000), (rows[len(rows) // 2 :], 10**10)):
            list(visits.handleInputRows((0,), iter(part), None))
            assert len(held.timers) == 1 and len(held.cells["waiting"]) <= 4
            held.timers.clear()
            watermark = type("Watermark", (), {"getCurrentWatermarkInMs": lambda self: now})()
            out += visits.handleExpiredTimer((0,), watermark, None)
        assert not held.timers and "waiting" not in held.cells
        return out

    got = run(Slot(), stateful.Visits(names, schema, "n", "event", "k"), markers)
    alone = [r for k in {r.k for r in markers} for r in run(Held(), stateful.Visits(names, schema, "n", "event"), [r for r in markers if r.k == k])]
    assert len(got) > 1000 and sorted(got, key=lambda r: r.n) == sorted(alone, key=lambda r: r.n)


def test_screens_whose_times_go_back(spark, tmp_path):
    """Ids go on while times start again, for the same users and for new ones: nothing is dropped as late."""
    rng = random.Random(5)
    start, rows = datetime(2024, 1, 1), []
    for copy in range(4):
        for n in range(150):
            kind = rng.choice(["click", "purchase", "signup", "view", "error"])
            rows.append((copy * 150 + n, start + timedelta(minutes=40 * n, microseconds=500_000 * rng.randrange(9)), rng.randrange(3) + copy // 2 * 2, kind))
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    got, want = (sorted(tuple(r) for r in q(spark, str(tmp_path)).where("seconds IS NOT NULL").collect()) for q in (stream_queries.screen_times_stream, queries.screen_times))
    assert got == want and any(r[3] < 0 for r in want)
