"""Conditional writes, keyed tables, copies, pages and the outbox against plain loops."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from coursefold.operators import chains, paging, records, tenants, versions
from coursefold.sources import files, pages, transfer
from coursefold.sources.keyed import Keyed
from coursefold.streaming import actions

WRITE = "k int, seq int, if_match string, mode string, a int, b string"


def store(start, writes):
    """A store that judges writes one by one."""
    rows, status = {k: [etag, a, b] for k, etag, a, b in start}, {}
    for k, seq, named, mode, a, b in sorted(writes, key=lambda w: w[1]):
        row = rows.get(k)
        if named is None:
            status[seq] = 409 if row else 204
        else:
            status[seq] = 404 if not row else 204 if named in ("*", row[0]) else 412
        if status[seq] == 204:
            whole = named is None or mode == "replace"
            rows[k] = [str(seq), a if whole or a is not None else row[1], b if whole or b is not None else row[2]]
    return status, rows


def test_conditional_writes(spark):
    for seed in range(3):
        rng = random.Random(seed)
        start = [(k, f"v{k}", k, None) for k in range(0, 8, 2)]
        writes, held = [], {k: [f"v{k}"] for k in range(8)}
        for seq in range(400):
            k = rng.randrange(8)
            named = rng.choice([None, "*", "none", *held[k][-3:], *held[k][-1:] * 12])
            writes.append((k, seq, named, rng.choice(["merge", "replace"]), rng.choice([None, seq]), rng.choice([None, f"b{seq}"])))
            if rng.random() < 0.9:
                held[k].append(str(seq))
        status, rows = store(start, writes)
        assert len(set(status.values())) == 4
        df, base = spark.createDataFrame(writes, WRITE), spark.createDataFrame(start, "k int, etag string, a int, b string")
        judged = versions.conditional_writes(base, df, ["k"]).cache()
        assert {r.seq: r.status for r in judged.collect()} == status
        assert {r.k: [r.etag, r.a, r.b] for r in versions.rows_after(base, judged, ["k"], ["a", "b"]).collect()} == rows
        # every pass of retries accepts one writer of a key, the first
        refused = {}
        for k, seq, *_ in writes:
            if status[seq] == 412:
                refused.setdefault(k, []).append(seq)
        want = {s: (min(n, 5), n <= 5) for all_ in refused.values() for n, s in enumerate(sorted(all_), 1)}
        assert {r.seq: (r.tries, r.accepted) for r in versions.retried(judged, ["k"], 5).collect()} == want
    assert versions.conditional_writes(base.limit(0), df.limit(0), ["k"]).count() == 0


def test_a_long_chain_of_versions(spark):
    """Each write names the one before: all are accepted, in as many rounds as their number has digits."""
    writes = spark.range(1, 3001).select(F.lit(1).alias("k"), F.col("id").cast("int").alias("seq"), (F.col("id") - 1).cast("string").alias("if_match"))
    base = spark.createDataFrame([(1, "0")], "k int, etag string")
    spark.sparkContext.setJobGroup("chain", "")
    assert versions.conditional_writes(base, writes, ["k"]).where("status = 204").count() == 3000
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain")) < 150
    spark.sparkContext.setJobGroup("", "")


def test_pointers(spark):
    links = [(1, i, i + 1) for i in range(9)] + [(2, 0, 5), (2, 5, 3), (2, 7, 8)]
    roots = spark.createDataFrame([(1, 2), (2, 0), (3, 4)], "k int, id long")
    got = chains.reachable(spark.createDataFrame(links, "k int, id long, next long"), roots, ["k"])
    assert sorted(map(tuple, got.collect())) == [(1, i) for i in range(2, 10)] + [(2, 0), (2, 3), (2, 5), (3, 4)]


def test_windows_from_first_use(spark):
    rng = random.Random(1)
    rows, n = [], 0
    for k in range(5):
        t = 0
        for _ in range(60):
            t = max(0, t + rng.choice([0, 0, 1, 2, 7, 30, -1]))
            rows.append((k, n, t))
            n += 1
    df = spark.createDataFrame(rows, "k int, n int, s int").withColumn("ts", F.timestamp_seconds("s"))
    rules = [(10, 3), (40, 7)]

    def plain(rules):
        out, state, clock = {}, {}, {}
        for k, n, t in rows:
            clock[k] = max(t, clock.get(k, t))
            ok = True
            for i, (seconds, permits) in enumerate(rules):
                s = state.setdefault((k, i), [clock[k], 0])
                if clock[k] >= s[0] + seconds:
                    s[:] = [clock[k], 0]
                if s[1] >= permits:
                    ok = False
                    break
                s[1] += 1
            out[n] = ok
        return out

    assert {r.n: r.admitted for r in records.used_window(df, "k", "ts", "n", *rules[0]).collect()} == plain(rules[:1])
    # a later rule starts its windows with the first event that the earlier rules admit
    assert {r.n: r.admitted for r in records.chained_limits(df, "k", "ts", "n", rules).collect()} == plain(rules)


def test_limits_take_one_pass(spark):
    """However many events and rules, the driver runs no job of its own, and one shuffle deals the events."""
    rows = [(n % 7, n, None if n % 11 == 5 else n * n % 5000) for n in range(3000)]
    df = spark.createDataFrame(rows, "k int, n int, s int").withColumn("ts", F.timestamp_seconds("s"))
    rules = [(60, 2), (900, 3), (3600, 50)]
    spark.sparkContext.setJobGroup("limits", "limits")
    out = records.chained_limits(df, "k", "ts", "n", rules)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("limits")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    want, state = {}, {}
    for k, n, s in rows:
        for i, (seconds, permits) in enumerate(rules):
            start, used = state.get((k, i), (None, 0))
            if not used or s is not None and start is not None and s >= start + seconds:
                start, used = s, 0
            state[k, i] = start, used + 1
            want[n] = used < permits
            if used >= permits:
                break
    assert {r.n: r.admitted for r in out.collect()} == want


def test_registration_in_bounded_rounds(spark):
    """A chain in which each refusal depends on the one before: the jobs do not follow its length."""
    jobs = {}
    for n in (200, 5000):
        rows = [(i, i // 2, (i + 1) // 2) for i in range(n)]
        users, families, want = set(), set(), {}
        for i, u, f in rows:
            want[i] = "already-registered" if u in users else "family-id-taken" if f in families else "registered"
            if want[i] == "registered":
                users.add(u)
                families.add(f)
        spark.sparkContext.setJobGroup(f"chain{n}", "")
        df = spark.createDataFrame(rows, "seq int, uid int, family_id int")
        assert {r.seq: r.result for r in tenants.register(df).collect()} == want
        jobs[n] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"chain{n}"))
    spark.sparkContext.setJobGroup("", "")
    assert jobs[5000] < 2 * jobs[200]


def scanned(df):
    """(files, rows) that the scan of ``df`` reads."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    while not plan.getClass().getSimpleName().endswith("FileSourceScanExec"):
        plan = plan.executedPlan() if "AdaptiveSparkPlan" in plan.getClass().getSimpleName() else plan.children().head()
    value = lambda name: plan.metrics().get(name).get().value()
    return value("numFiles"), value("numOutputRows")


def test_keyed_tables(spark, tmp_path):
    table = Keyed(f"{tmp_path}/t", "family", "row", buckets=16)
    # one family holds a third of all rows
    rows = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("f"), F.col("id") % 500)).alias("family"), F.format_string("s_%06d", "id").alias("row"), (F.col("id") * 2).alias("v"))
    table.write(rows, **{"parquet.block.size": 4096, "parquet.page.row.count.limit": 500})
    point = table.point(spark, "hot", "s_030000")
    assert [r.v for r in point.collect()] == [60_000] and table.point(spark, "hot", "s_030001").count() == 0 and table.point(spark, "no", "x").count() == 0
    plan = point._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [IsNotNull(family), IsNotNull(row), EqualTo(family,hot), EqualTo(row,s_030000)]" in plan
    found, read = scanned(point)
    assert found <= 4 and read < 2000  # the folder of one bucket, and of the 20,000 rows of the family a page or two
    some = table.prefix(spark, "hot", "s_0300")
    assert sorted(r.row for r in some.collect()) == [f"s_{i:06d}" for i in range(30_000, 30_100) if i % 3 == 0]
    assert scanned(some)[1] < 2500
    asked = spark.createDataFrame([("hot", "s_000003"), ("f1", "s_000001"), ("f1", "none")], "family string, row string")
    assert sorted(r.v for r in table.lookup(asked).collect()) == [2, 6]
    with pytest.raises(ValueError):
        table.write(rows.withColumn("bucket", F.lit(1)))


def test_copies(spark, tmp_path, monkeypatch):
    source, target = tmp_path / "a", tmp_path / "b"
    for name in ("refined/x/1.json", "refined/x/2.json", "catalog.json"):
        (source / name).parent.mkdir(parents=True, exist_ok=True)
        (source / name).write_text(name)
    (target / "refined").mkdir(parents=True)
    (target / "refined/old.json").write_text("of an earlier try")
    there = lambda: sorted(str(p.relative_to(target)) for p in target.rglob("*") if p.is_file())
    real = transfer.write_files

    def meddling(*args):
        real(*args)
        (source / "refined/x/2.json").write_text("changed while it was copied")

    monkeypatch.setattr(transfer, "write_files", meddling)
    with pytest.raises(transfer.NotReady, match="refined/x/2.json"):
        transfer.copy_folder(spark, str(source), str(target), "1")
    assert not transfer.is_ready(spark, str(target))
    monkeypatch.setattr(transfer, "write_files", real)
    assert transfer.copy_folder(spark, str(source), str(target), '{"v": 1}')
    assert there() == ["catalog.json", "refined/x/1.json", "refined/x/2.json", "version.json"] and (target / "version.json").read_text() == '{"v": 1}'
    assert (target / "refined/x/2.json").read_text() == "changed while it was copied"
    assert not transfer.copy_folder(spark, str(source), str(target), "2")  # it is ready: nothing is copied again
    with pytest.raises(transfer.NotReady):
        transfer.copy_folder(spark, str(tmp_path / "none"), str(tmp_path / "c"), "1")
    # a task that fails: there is no marker, and what it has written itself is gone
    rows = spark.range(40).select(F.concat(F.lit("d/"), F.col("id")).alias("name"), F.lit("x").alias("content"))
    bad = rows.unionByName(spark.createDataFrame([("d/\0", "x")], "name string, content string")).coalesce(1)
    with pytest.raises(PySparkException):
        transfer.write_files(bad, str(tmp_path / "e"), "version.json", "1")
    assert not [p for p in (tmp_path / "e").rglob("*") if p.is_file()]
    writer = transfer.FileWriter({"target": str(tmp_path / "e"), "marker": "version.json", "job": "j"})
    message = writer.write(iter(rows.where("id < 5").withColumn("content", F.col("content").cast("binary")).collect()))  # another task had ended: the abort finds what it wrote
    assert len(list((tmp_path / "e/d").iterdir())) == 5
    writer.abort([message, None])
    assert not [p for p in (tmp_path / "e").rglob("*") if p.is_file()]
    transfer.write_files(rows.repartition(4), str(tmp_path / "e"), "version.json", "1")
    assert len([p for p in (tmp_path / "e").rglob("*") if p.is_file()]) == 41


def test_pages_as_a_source(spark, tmp_path):
    rows = [(c, n, f"t{n}", None if n % 5 == 0 else n / 2) for c, size in (("a", 7), ("b b", 3), ("c", 1)) for n in range(1, size + 1)]
    df = spark.createDataFrame(rows, "chain string, n int, title string, score double")
    made = pages.as_pages(df.select("chain", "n", "title", "score"), "chain", "n", paging.encoded, 3)
    transfer.write_files(made, str(tmp_path / "p"))
    items = "title string not null, score double"
    got = pages.paged(spark, str(tmp_path / "p"), items)
    assert got.rdd.getNumPartitions() == 3
    assert [tuple(r) for r in got.collect()] == [(c, t, s) for c, _, t, s in rows]
    second = f"a/{paging.encode(3)}.json"
    with pytest.raises(PySparkException, match=f"{second}: score of item 1"):
        pages.paged(spark, str(tmp_path / "p"), "title string not null, score double not null").collect()
    (tmp_path / "p" / second).write_text('{"items": [{"title": 4}], "nextCursor": null}')
    with pytest.raises(PySparkException, match=f"{second}: title of item 0"):
        pages.paged(spark, str(tmp_path / "p"), items).collect()
    bad = {"no JSON": "{", "no items": '{"nextCursor": null}', "cursor that is no text": '{"items": [], "nextCursor": 3}', "no object": '{"items": [1], "nextCursor": null}', "comes back": '{"items": [], "nextCursor": "first"}', "cannot be read": '{"items": [], "nextCursor": "Ng"}'}
    (tmp_path / "q/x").mkdir(parents=True)
    for why, text in bad.items():
        (tmp_path / "q/x/first.json").write_text(text)
        with pytest.raises(PySparkException, match=why):
            pages.paged(spark, str(tmp_path / "q"), items).collect()


def test_cursor_columns(spark):
    rng = random.Random(2)
    cursors = [None, "", "MQ", "MQ=", "M Q", "!", paging.encode(0), paging.encode(10**12), paging.encode(10**11) + "A", "MR", "LTE", "KzE", "A", "ABCDE", "МQ"]
    cursors += [paging.encode(rng.randrange(40)) for _ in range(50)] + ["".join(rng.choices("MTIzNDU2Nzg5_-", k=rng.randint(1, 6))) for _ in range(300)]

    def plain(c):
        try:
            return paging.decode(c, 20)
        except paging.InvalidPage:
            return None

    df = spark.createDataFrame([(i, c) for i, c in enumerate(cursors)], "i int, c string")
    assert {r.i: r.at for r in df.select("i", paging.decoded(F.col("c"), F.lit(20)).alias("at")).collect()} == {i: plain(c) for i, c in enumerate(cursors)}
    n = spark.range(0, 5000, 7)
    assert all(r.c == paging.encode(r.id) for r in n.select("id", paging.encoded(F.col("id")).alias("c")).collect())


def test_outbox(spark, tmp_path):
    df = spark.range(30).repartition(3)

    def send(rows):
        if any(r["id"] == 29 for r in rows):
            raise OSError("the broker is away")
        return [r["id"] % 3 != 0 for r in rows]

    run = actions.outbox(lambda rows: [r["id"] % 3 != 0 for r in rows], f"{tmp_path}/sent", ["id"])
    for _ in range(2):  # a batch that is run again adds no second mark
        run(df.where("id < 15"), 0)
    run(df.where("id >= 15").coalesce(1), 1)
    marks = lambda: sorted(r.id for r in spark.read.parquet(f"{tmp_path}/sent").collect())
    assert marks() == [i for i in range(30) if i % 3]
    actions.outbox(send, f"{tmp_path}/sent", ["id"])(df.where("id >= 15").coalesce(1), 1)
    assert marks() == [i for i in range(15) if i % 3]


def test_actions_of_the_last_minutes_are_resent(spark, tmp_path):
    """The start-up pass comes after the last record has waited, whenever that was."""
    from coursefold.plans.source_queries import outbox_resent

    rows = [(0, 1, "2024-01-30 23:59:00"), (1, 2, "2024-01-30 23:59:30"), (3, 3, "2024-02-09 12:00:00"), (6, 1, "2024-01-02 10:00:00"), (9, None, "2024-01-02 10:00:00"), (11, None, "2024-01-03 10:00:00")]
    df = spark.createDataFrame(rows, "event_id long, user_id long, at string")
    df.select("event_id", "user_id", F.col("at").cast("timestamp_ntz").alias("ts")).write.parquet(f"{tmp_path}/events.parquet")
    got = {tuple(r) for r in outbox_resent(spark, str(tmp_path)).collect()}
    assert got == {(1, "2024-01-30"), (3, "2024-02-09"), (1, "2024-01-02"), (None, "2024-01-02")}


def test_grades_of_entries(spark):
    raw = ['{"grade":4}', '{"grade":"4"}', '{"grade":"4","x":{"grade":4}}', '{"x":{"grade":4}}', '{"grade":4.0}', '{"grade":4e0}', "[4]", "no json", '{"grade":null}', None, '{"grade": 4, "x": {"grade": 5}}', '{"grade":5}']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "pos int, raw string")
    assert sorted(r.pos for r in files.catalog_entries(df, 4).collect()) == [0, 10]
