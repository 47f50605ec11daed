import base64
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from coursefold.functions import keys, text, tokens
from coursefold.operators import fold, listing, paging, records, slices, tenants
from coursefold.sources import files
from coursefold.streaming import actions

EVENT = "family_id int, child_id int, class_level int, chapter_id string, seq long, kind string, occurred_at long, plan_id string, concept_count int, concept_id string, check_id string, right_count int, of_count int"


def direct(events):
    """The fold's rules one event at a time."""
    state = {}
    for *key, seq, kind, at, plan, count, concept, check, right, of in sorted(events, key=lambda e: e[4]):
        ch = tuple(key)
        s = state.get(ch)
        if kind == "plan":
            if s and s["plan"] == plan:
                continue
            s = state.setdefault(ch, {"attempts": 0, "checks": 0, "right": None, "of": None})
            s.update(plan=plan, attempts=s["attempts"] + 1, count=count, done=set(), taken=set(), last=at)
        elif s is None:
            continue
        elif kind == "concept":
            if concept in s["done"] or len(s["done"]) >= s["count"]:
                continue
            s["done"].add(concept)
            s["last"] = at
        else:
            if not of or check in s["taken"]:
                continue
            s["taken"].add(check)
            s.update(checks=s["checks"] + 1, right=right, of=of, last=at)
    return {(*c, s["attempts"], s["count"], len(s["done"]), len(s["taken"]), s["checks"], s["right"], s["of"], s["last"]) for c, s in state.items()}


def random_events(n, seed=3):
    rng, out = random.Random(seed), []
    for seq in range(n):
        kind = rng.choice(["plan", "concept", "concept", "concept", "check"])
        out.append((rng.randrange(2), rng.randrange(2), rng.randrange(1, 3), f"ch{rng.randrange(4)}", seq, kind, rng.randrange(10**6), f"p{rng.randrange(2)}" if kind == "plan" else None, rng.randrange(5) if kind == "plan" else None, f"c{rng.randrange(6)}" if kind == "concept" else None, f"q{rng.randrange(3)}" if kind == "check" else None, 1 if kind == "check" else None, rng.randrange(3) if kind == "check" else None))
    return out


COLUMNS = ["family_id", "child_id", "class_level", "chapter_id", "attempt_count", "concept_count", "concepts_done", "latest_checks", "check_count", "latest_right", "latest_of", "last_activity"]


def test_fold_is_the_rules_in_order(spark):
    events = random_events(1500)
    got = {tuple(r) for r in fold.summaries(spark.createDataFrame(events, EVENT)).select(COLUMNS).collect()}
    assert got == direct(events)


def test_stream_folds_as_the_batch(spark, tmp_path):
    events = random_events(300, 5)
    for k in range(3):
        spark.createDataFrame(events[k * 100 : k * 100 + 100], EVENT).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    stream.writeStream.foreachBatch(actions.fold_batches(f"{tmp_path}/log", f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    table = spark.read.option("basePath", f"{tmp_path}/out").parquet(f"{tmp_path}/out")
    assert {tuple(r) for r in actions.current(table).select(COLUMNS).collect()} == direct(events)


def test_handled_once(spark, tmp_path):
    seen = []
    run = actions.handle_once(f"{tmp_path}/done", ["id"], lambda df: seen.extend(r.id for r in df.collect()))
    run(spark.createDataFrame([(1,), (1,), (2,)], "id int"), 0)
    run(spark.createDataFrame([(2,), (3,)], "id int"), 1)
    assert sorted(seen) == [1, 2, 3]


def test_states(spark):
    def plain(checks, done, count):
        if count is None:
            return "not-started"
        if checks:
            return "checked"
        return "taught" if count and done >= count else "planned"

    rows = [(c, d, n, plain(c, d, n)) for c in range(3) for d in range(3) for n in range(3)] + [(None, None, None, plain(None, None, None))]
    df = spark.createDataFrame(rows, "checks int, done int, n int, want string")
    assert df.where(text.chapter_state(F.col("checks"), F.col("done"), F.col("n")) != F.col("want")).count() == 0


def test_cursors():
    """What the codec makes of an offset is read back below the count; whatever breaks one of its rules is refused."""
    for count in (2, 12, 10**9):
        for offset in (1, count // 2, count - 1):
            assert paging.decode(paging.encode(offset), count) == offset
        bad = [paging.encode(n) for n in (0, count, count + 1)]  # below, at and past the range
        bad += [base64.urlsafe_b64encode(t).decode().rstrip("=") for t in (b"one", b"+1", b"1.0", b" 1", "\u0661".encode(), b"")][:5]  # not all ASCII digits
        bad += ["MQ=", "M Q", "M.Q", "\u041cQ", paging.encode(10**12) + "A"]  # outside of the alphabet, or too long
        for cursor in bad:
            with pytest.raises(paging.InvalidPage):
                paging.decode(cursor, count)


def test_pages(spark):
    rows, got, cursor = spark.range(7), [], None
    while True:
        page, cursor = paging.page(rows, ["id"], 3, cursor)
        got += [r.id for r in page.collect()]
        if not cursor:
            break
    assert got == list(range(7)) and paging.encode(50) == "NTA" and paging.decode("", 0) == 0
    for limit in (-1, 0, 101):
        with pytest.raises(paging.InvalidPage):
            paging.page(rows, ["id"], limit)
    with pytest.raises(paging.InvalidPage):
        paging.page(rows.where("id < 0"), ["id"], 3, paging.encode(1))


MANIFEST = """{"schema": "%s", "board": "cbse", "class": 7, "subjects": [{"subjectId": "m", "name": "Sums", "icon": "x", "chapterCount": %d,
 "chapters": [{"chapterId": "a1", "bookId": "a", "number": 1, "title": "One"}, {"chapterId": "a2", "bookId": "a", "number": 2, "title": "Two"}, {"chapterId": "b1", "bookId": "b", "number": 1, "title": "Three"}]}]}"""


def test_manifest_numbers_through_books(spark, tmp_path):
    (tmp_path / "m.json").write_text(MANIFEST % ("v1", 3))
    rows = files.flattened(files.manifests(spark, str(tmp_path / "m.json"), "v1")).orderBy("number").collect()
    assert [(r.number, r.chapter_id) for r in rows] == [(1, "a1"), (2, "a2"), (3, "b1")]
    for bad in (MANIFEST % ("v2", 3), MANIFEST % ("v1", 2)):
        (tmp_path / "m.json").write_text(bad)
        rows = files.manifests(spark, str(tmp_path / "m.json"), "v1")
        for read in (rows.collect, rows.count, files.flattened(rows).collect, rows.select("class").collect):
            with pytest.raises(PySparkException):
                read()


def test_catalog_grade_is_a_number(spark):
    raw = ['{"grade": 4, "x": 1}', '{"grade": "4"}', '{"grade": 4.5}', '{"grade": 14}']
    rows = files.catalog_entries(spark.createDataFrame([(r,) for r in raw], "raw string"), 4).collect()
    assert [r.raw for r in rows] == raw[:1]


def test_prefix_does_not_match_longer_ids(spark):
    df = spark.createDataFrame([("s/cxyz1/a",), ("s/cxyz10/a",)], "name string")
    assert files.prefix_scan(df, "name", "s/cxyz1/").count() == 1
    with pytest.raises(ValueError):
        keys.prefix_successor("")


def test_tokens(spark):
    df = spark.createDataFrame([("p", "u")], "p string, u string")
    t = df.withColumn("t", tokens.seal(F.col("p"), F.col("u"), b"k", "a"))
    r = t.select(tokens.open_sealed(F.col("t"), F.col("u"), b"k", "a").alias("ok"), tokens.open_sealed(F.col("t"), F.col("p"), b"k", "a").alias("other"), tokens.open_sealed(F.col("t"), F.col("u"), b"k", "b").alias("purpose"), tokens.open_sealed(F.lit("x.y"), F.col("u"), b"k", "a").alias("bad")).first()
    assert tuple(r) == ("p", None, None, None)


def test_chained_limits_keep_the_earlier_permit(spark):
    rows = [(1, 0, 1), (1, 1, 2), (1, 61, 3), (1, 122, 4), (2, 0, 5)]
    df = spark.createDataFrame(rows, "k int, s int, n int").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.n: r.admitted for r in records.chained_limits(df, "k", "ts", "n", [(60, 1), (3600, 2)]).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False, 5: True}


def test_trace_links_of_digests_without_letters(spark, tmp_path):
    """An upper-case digest that has digits only is valid, to the query and to its SQL."""
    import duckdb

    from coursefold.plans.registry import ORACLE_SQL
    from coursefold.plans.tenant_queries import trace_links

    spark.createDataFrame([(n,) for n in (0, 1, 2, 3, 1518375)], "event_id long").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.event_id: r.link for r in trace_links(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    found = con.execute(ORACLE_SQL["trace_links"])
    assert got == dict(found.fetchall()) and {n for n, link in got.items() if link} == {2, 1518375}


def test_snapshots_and_missing_files(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "2")], "name string, etag string")
    b = spark.createDataFrame([("x", "1"), ("z", "2")], "name string, etag string")
    assert {r.name for r in records.snapshot_diff(a, b, "name", "etag").collect()} == {"y", "z"}
    refined = spark.createDataFrame([("refined/b/1.json",), ("refined/b/2.json",), ("refined/b10/2.json",)], "name string")
    there = spark.createDataFrame([("plans/b/1.plan.json",), ("plans/b/2.json",), ("summaries/b/2.json",), ("summaries/b10/2.json",)], "name string")
    assert [r.name for r in records.missing_files(refined, there, "plans").orderBy("name").collect()] == ["refined/b/2.json", "refined/b10/2.json"]
    assert [r.name for r in records.missing_files(refined, there, "summaries").collect()] == ["refined/b/1.json"]


def test_text_rules(spark):
    r = spark.range(1).select(
        text.recovery_groups(F.lit("ab cd-efgh2")).alias("code"), text.name_list(F.array(F.lit("A"), F.lit("B"), F.lit("C"))).alias("names"), text.backoff_seconds(F.lit(0)).alias("none"), text.backoff_seconds(F.lit(9)).alias("most"),
        keys.kebab(F.lit("ParkLateMailFunction")).alias("kebab"), text.code_digits(F.lit("12-34 567")).alias("digits"), text.matches_words(F.lit(" Dark  mode"), F.lit("dark theme mode")).alias("all"),
    ).first()
    assert tuple(r) == ("ABCD-EFGH-2", "A, B and C", 0.0, 300.0, "park-late-mail", "123456", True)
    with pytest.raises(ValueError):
        listing.search(spark.range(1).withColumn("t", F.lit("")), "t", "x" * 65)


def one(spark, *columns):
    r = tuple(spark.range(1).select(*columns).first())
    return r if len(r) > 1 else r[0]


def test_small_text_rules(spark):
    ok = lambda f, *texts: [one(spark, f(F.lit(t))) for t in texts]
    assert ok(keys.is_book_id, "a.B_1-2", "a/b", "a\n", "") == [True, False, False, False]
    assert ok(text.no_controls, "a b", "a\tb", "") == [True, False, False] and ok(text.six_digits, "012345", "01234", "0123456", "01234\n") == [True, False, False, False]
    assert ok(text.is_kebab, "a-b1", "A-b", "a--b", "-a") == [True, False, False, False]
    assert ok(text.valid_region, "Pune", "  ", "x" * 61, "a\u200bb") == [True, False, False, False] and ok(text.valid_school, "", "x" * 101) == [True, False]
    assert one(spark, keys.action_id(F.lit("a"), F.lit("b"))) == "a_b" and one(spark, text.split_list(F.lit("a,,b,"))) == ["a", "b"]
    ts = lambda t: F.lit(t).cast("timestamp")
    assert one(spark, text.seconds_left(ts("2024-01-01 00:00:01.2"), ts("2024-01-01")), text.seconds_left(ts("2024-01-01"), ts("2024-01-02"))) == (2, 0)
    assert [one(spark, text.day_part(ts(f"2024-03-05 {h}:59:59"))) for h in (11, 16, 17)] == ["morning", "afternoon", "evening"]
    assert one(spark, text.first_word(F.lit("  Ada  B")), text.initial(F.lit("ada")), text.short_date(ts("2024-03-05"))) == ("Ada", "A", "5 Mar")
    assert one(spark, text.initial(F.lit(" ada")), text.first_word(F.lit("\u00a0Ada\u00a0B")), text.first_word(F.lit("\ufeff "))) == (" ", "Ada", "")
    assert ok(text.valid_region, "\u00a0", "\U0001f600" * 31, "\U0001f600" * 30, "\u00a0x") == [False, False, True, True]
    assert one(spark, text.listed_or(F.lit("x"), ["a"], "book"), text.looked_up(F.lit("zz"), text.REASONS, "other"), text.looked_up(F.lit("zz"), {"settings": "appearance"})) == ("book", "other", None)
    assert one(spark, keys.check_key(F.lit("a-b"), F.lit(3), F.lit("ch"), F.lit(1), F.lit(12)), keys.path("x", F.lit(3), folder=True)) == ("c_ab_03_ch_001_012", "x/3/")
    with pytest.raises(PySparkException):
        one(spark, text.http_status(F.lit("no-such-code")))
    assert records.retry_budget(10, 5, 51) == 50
    with pytest.raises(ValueError):
        records.retry_budget(10, 5, 50)


def test_verdicts_and_proofs(spark):
    now, at = F.lit("2024-01-01").cast("timestamp"), lambda t: F.lit(t).cast("timestamp")
    v = lambda opened, uid, ends: one(spark, tokens.verdict(opened, F.lit(uid), F.lit("me"), at(ends), now))
    none, some = F.lit(None).cast("string"), F.lit("{}")
    assert [v(none, "me", "2023-01-01"), v(some, "you", "2023-01-01"), v(some, "me", "2024-01-01"), v(some, "me", "2024-01-02")] == ["wrong", "wrong", "expired", "ok"]
    assert not one(spark, tokens.proven(none, F.lit("me"), F.lit("o"), F.lit("t"), now))


def test_stored_values(spark):
    rows = [("a", '{"x": 1}'), ("b", "{bad"), ("c", None), ("d", ""), ("e", '{"y": 2}'), ("f", "[1]")]
    df = spark.createDataFrame(rows, "k string, v string")
    default = F.struct(F.lit(-1).alias("x"))
    got = {r.k: r.v.x for r in df.select("k", files.stored_value(F.col("v"), "x int", default, ("x",)).alias("v")).collect()}
    assert got == {"a": 1, "b": -1, "c": -1, "d": -1, "e": -1, "f": -1}


def test_files_below_a_prefix(spark, tmp_path):
    for name in ("s/b1/a.json", "s/b10/a.json", "s/top.json"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text('[{"grade": 4, "more": [1]}, {"grade": "4"}]')
    assert {r.name for r in files.file_listing(spark, str(tmp_path)).collect()} == {"s/b1/a.json", "s/b10/a.json", "s/top.json"}
    below = files.file_listing(spark, str(tmp_path), "s/b1/", content=True).collect()
    assert [r.name for r in below] == ["s/b1/a.json"] and below[0].content.startswith(b"[")
    with pytest.raises(ValueError):
        files.file_listing(spark, str(tmp_path), "s/b1")
    raw = files.json_array(spark, str(tmp_path / "s/top.json"))
    assert [(r.pos, r.raw) for r in raw.collect()] == [(0, '{"grade":4,"more":[1]}'), (1, '{"grade":"4"}')]
    assert [r.pos for r in files.catalog_entries(raw, 4).collect()] == [0]
    have = spark.createDataFrame([("a", "1")], "name string, etag string")
    assert files.required(spark.createDataFrame([("a",)], "name string"), have).first().etag == "1"
    with pytest.raises(PySparkException):
        files.required(spark.createDataFrame([("a",), ("b",)], "name string"), have).select("etag").collect()
    assert files.point_lookup(have, name="a", etag="1").count() == 1 and files.point_lookup(have, name="b").count() == 0


def test_slices_that_cannot_be_read(spark):
    judged = spark.createDataFrame([("ssc", "b", "broken", "no-plan", "refined/b/1.json")], "board string, book_id string, state string, fault string, first string")
    listing_ = spark.createDataFrame([("refined/b/1.json",)], "name string")
    with pytest.raises(PySparkException, match="no-plan"):
        slices.slice_files(judged, listing_).collect()
    with pytest.raises(PySparkException, match="listed twice"):
        slices.disjoint_union(listing_.withColumn("n", F.lit(1)), listing_.withColumn("n", F.lit(2))).collect()
    with pytest.raises(ValueError):
        slices.without_prefix(listing_, "refined/b")


def test_lifecycle_one_event_at_a_time(spark):
    rng = random.Random(9)
    events = [(rng.randrange(6), n, rng.choice(["added", "deleting", "removed"]), n) for n in range(120)]
    state = {}
    for key, _, event, what in events:
        if event == "added":
            state.setdefault(key, [what, "active"])
        elif event == "deleting" and key in state:
            state[key][1] = "deleting"
        elif event == "removed":
            state.pop(key, None)
    df = spark.createDataFrame(events, "k int, seq int, event string, what int")
    assert {r.k: [r.what, r.status] for r in tenants.lifecycle(df, ["k"]).collect()} == state


def test_registration_one_request_at_a_time(spark):
    rng = random.Random(3)
    rows = [(n, rng.randrange(12), rng.randrange(12)) for n in range(80)]
    users, families, want = set(), set(), {}
    for n, u, f in rows:
        want[n] = "already-registered" if u in users else "family-id-taken" if f in families else "registered"
        if want[n] == "registered":
            users.add(u)
            families.add(f)
    df = spark.createDataFrame(rows, "seq int, uid int, family_id int")
    assert {r.seq: r.result for r in tenants.register(df).collect()} == want
    assert tenants.register(df.limit(0)).count() == 0


def test_actions_without_a_record_are_skipped(spark, tmp_path):
    seen = []
    recorded = spark.createDataFrame([(1,), (3,)], "id int")
    run = actions.handle_once(f"{tmp_path}/done", ["id"], lambda df: seen.extend(r.id for r in df.collect()), ledger=lambda: recorded, keep_days=2)
    for k in range(2):
        run(spark.createDataFrame([(1,), (2,), (3,)], "id int"), k)
    assert sorted(seen) == [1, 3]


def test_dispatch(spark, tmp_path):
    got = {"a": [], "parked": []}
    put = lambda name: lambda df: got[name].extend(r.action_id for r in df.collect())
    rows = [("a", "1", "x", []), ("a", "2", None, [(3,)]), ("a", "3", None, [(2,)]), ("b", "4", "x", None), ("a", "5", "x", [(1,), (2,)])]
    df = spark.createDataFrame(rows, "routing_key string, action_id string, body string, x_death array<struct<count:int>>")
    actions.dispatch({"a": put("a")}, put("parked"), F.col("body").isNotNull(), 2)(df)
    assert sorted(got["a"]) == ["1", "5"] and sorted(got["parked"]) == ["2", "4"]
    spark.createDataFrame([("a", "1"), ("b", "2")], "routing_key string, action_id string").coalesce(1).write.json(f"{tmp_path}/in")
    out = actions.publish(actions.deliveries(spark, f"{tmp_path}/in", "a"), f"{tmp_path}/out", f"{tmp_path}/ck")
    out.trigger(availableNow=True).start().awaitTermination()
    assert [r.action_id for r in spark.read.json(f"{tmp_path}/out").collect()] == ["1"]


def test_numbering_in_two_levels(spark):
    rng = random.Random(4)
    rows = spark.createDataFrame([(rng.randrange(3), n, rng.choice(text.STATES)) for n in rng.sample(range(1000), 200)], "g int, n int, state string")
    plain = listing.number_rows(rows, "g", "n")
    pieces = listing.number_rows(rows, "g", "n", piece=F.shiftright("n", 4))
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, pieces.select(plain.columns).collect()))
    whole = {r.g: r.states for r in listing.states_in_order(plain, "g").collect()}
    parts = listing.states_in_order(plain, "g", 7).orderBy("g", "first").collect()
    for g, states in whole.items():
        own = [r for r in parts if r.g == g]
        assert ",".join(r.states for r in own) == states and [r["first"] for r in own] == [1 + 7 * k for k in range(len(own))]
    assert {r.g: (r.x, r.n) for r in listing.x_of_n(rows, "g").collect()} == {g: (s.split(",").count("checked"), len(s.split(","))) for g, s in whole.items()}
