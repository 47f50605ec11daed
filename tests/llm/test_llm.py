import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from coursefold.llm import ann, decontamination, language, lines, packing, registry, repeats, revisits, scoring, sharding, simhash

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, h string, _n int"
WORDS = "red green blue one two three four five six seven eight nine ten sun moon star".split()


def odd_docs():
    """Nulls, empty and long texts, repeated rows, ties and columns whose names clash with inner ones."""
    rng = random.Random(1)
    text = lambda n: " ".join(rng.choices(WORDS, k=n))
    long, shared = text(3000), text(60)
    texts = [None, "", "   \n\n", "x", "ÄÖÜ straße don't 12!", long, long, shared + "\n" + text(9), text(7) + "\n" + shared, shared, "!!!" * 300, "a" * 900]
    rows = [(i, t, "en", "s", 1, "h", 1) for i, t in enumerate(texts)]
    return rows + [rows[7], rows[7], (None, shared, None, None, None, None, None), (3, "another text with the same id", None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_docs(), DOCS).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


#: Names that the operators use for columns of their own.
INNER = ["row", "d", "t", "i", "n", "s", "k", "e", "id", "stay", "lines", "left", "none", "text_hash", "fp", "component", "score", "lang_pred", "rejected", "chars", "cross_entropy", "n_lines", "n_dropped", "n_words", "spans", "items", "n_hit", "contaminated", "_d", "_t", "_n", "_hash", "_text", "_copy", "_row"]


def with_clashes(docs):
    return docs.drop("_n").select("*", *(F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))).alias(c) for c in INNER))


def unchanged(rows):
    """The extra columns hold what ``with_clashes`` put there."""
    rows = rows.collect()
    return bool(rows) and all(r[c] == f"{c}{'?' if r.doc_id is None else r.doc_id}" for r in rows for c in INNER)


def check_packing(rows, docs):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = collections.defaultdict(list)
    for d in docs:
        ids[d[0]].append([*tok.encode(d[1] or "", add_special_tokens=False).ids, 2])
    total, sequences = 0, collections.defaultdict(list)
    for r in rows:
        assert any(len(x) == r.doc_tokens and zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
        total += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    assert total == sum(len(x) for v in ids.values() for x in v)
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    return sum(0 if (n := sum(x for _, x in p)).bit_count() == 1 else 4096 - n for p in sequences.values()), total


def test_packing(spark, docs, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    check_packing(packing.pack(docs, path).collect(), odd_docs())
    assert packing.pack(none, path).count() == 0
    real = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    padding, total = check_packing(packing.op1_window_packing(spark, SF).collect(), real)
    assert padding < 0.01 * total


def test_windows_are_bounded_and_best_fit():
    """At most ``most`` are open; the smallest gap that is large enough is taken, and the fullest goes when none is."""
    rng, size, most, least = random.Random(3), 100, 5, 4
    windows, used, closed, order = packing.OpenWindows(size, most, least), {}, [], []
    for doc in range(400):
        length = rng.choice([3, 17, 40, 61, 99, 100, 250])
        start, left = 0, length
        # the same rules, looked up in a plain table of gaps
        while left:
            take = min(left, size)
            fit = [(g, w) for w, g in used.items() if g >= take]
            if not fit and len(used) == most:
                gap, w = min((g, w) for w, g in used.items())
                if gap >= least:
                    order.append((doc, start, gap, w))
                    start, left = start + gap, left - gap
                del used[w]
                continue
            gap, w = min(fit) if fit else (size, len({x[3] for x in order}))
            order.append((doc, start, take, w))
            used[w] = gap - take
            if not used[w]:
                del used[w]
            start, left = start + take, left - take
        for held in windows.place((doc,), 0, length):
            closed.append([(d[0], s, n) for d, s, n in held])
            assert sum(n for _, _, n in closed[-1]) > size - least
        assert len(windows.held) == len(windows.gaps) <= most
    want = collections.defaultdict(list)
    for doc, start, n, w in order:
        want[w].append((doc, start, n))
    still = [[(d[0], s, n) for d, s, n in held] for held in windows.held.values()]
    assert sorted(closed + still) == sorted(want.values())


def agree(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = con.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    df = registry.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(str, (tuple(r[c] for c in names) for r in df.collect()))) == sorted(map(str, map(tuple, found.fetchall())))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql(spark, name):
    agree(spark, name)


def test_scores_of_odd_texts(docs, none):
    got = scoring.score_documents(docs).collect()
    assert len(got) == len(odd_docs()) and all(r.log10_score <= 0 and np.isfinite(r.log10_score) for r in got)
    assert {r.log10_score for r in got if r.n_words == 0} == {0.0}
    assert scoring.score_documents(none).count() == 0


@pytest.mark.parametrize("min_count", [1, 2, 3])
def test_scores_by_plain_counts(docs, min_count):
    split = [re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), d[1] or "")) for d in odd_docs()]
    count = collections.Counter(tuple(w[i : i + n]) for w in split for n in (1, 2, 3) for i in range(len(w) - n + 1))
    total = sum(map(len, split))

    def score(gram, backoff=1.0):
        if len(gram) == 1:
            return math.log10(backoff * count[gram] / total)
        if count[gram] >= min_count:
            return math.log10(backoff * count[gram] / count[gram[:-1]])
        return score(gram[1:], backoff * 0.4)

    want = sorted((d[0] is None, d[0] or 0, len(w), round(sum(score(tuple(w[max(0, i - 2) : i + 1])) for i in range(len(w))), 5)) for d, w in zip(odd_docs(), split))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, round(r.log10_score, 5)) for r in scoring.score_documents(docs, min_count=min_count).collect())
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-4)


def test_scores_back_off(spark, tmp_path):
    """A text that stands twice is seen; what only the scored text holds backs off, in the query and in its SQL."""
    texts = ["a b c", "a b c", "a d c"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    twice = 3 / 9 * 2 / 3 * 2 / 2
    once = 3 / 9 * (0.4 * 1 / 9) * (0.4 * 0.4 * 3 / 9)
    want = [(i, 3, round(math.log10(p), 4)) for i, p in enumerate((twice, twice, once))]
    assert sorted(map(tuple, scoring.op2_stupid_backoff(spark, str(tmp_path)).collect())) == want
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(con.execute(scoring.OP2_SQL).fetchall()) == want


def test_line_dedup(spark, docs, none):
    got = lines.dedup_lines(docs)
    assert got.count() == len(odd_docs()) and got.columns[: len(docs.columns)] == docs.columns
    by = {(r.doc_id, r.n_chars): r.text for r in got.collect()}
    assert by[(0, 1)] is None and by[(6, 1)] == "" and by[(9, 1)] == "" and by[(None, None)] == ""
    out = lines.dedup_lines(with_clashes(docs))
    assert unchanged(out) and out.columns[-2:] == ["_n_lines", "_n_dropped"]
    assert lines.dedup_lines(none).count() == 0
    three = [(0, "a b c d e f"), (1, "a b c X e f\nkeep\nkeep"), (2, "a b c X Y f"), (3, "a b d e f"), (4, "b c d e f a")]
    left = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(three, "doc_id long, text string")).collect()}
    assert left == {0: "a b c d e f", 1: "keep", 2: "", 3: "", 4: "b c d e f a"}


def test_near_lines_of_any_length(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefgh", k=3))
    base = [[word() for _ in range(n)] for n in (4, 5, 6, 9, 20, 100) for _ in range(6)]
    made = [list(b) for b in base]
    for b in base:
        for edits in (1, 1, 1, 2):
            x = list(b)
            for _ in range(edits):
                at = rng.randrange(len(x))
                x[at : at + 1] = rng.choice([[], [word()], [x[at], word()], [x[at], x[at]]])
            made.append(x)
    hot = [base[20][:10] + [word() for _ in range(10)] for _ in range(300)]  # a shared half, not near
    texts = [" ".join(x) for x in made + hot + [[w.upper() for w in base[33]]]]
    rng.shuffle(texts)

    def near(x, y):
        if len(x) > len(y):
            x, y = y, x
        if len(x) == len(y):
            return sum(a != b for a, b in zip(x, y)) <= 1
        return len(y) == len(x) + 1 and any(y[:i] + y[i + 1 :] == x for i in range(len(y)))

    words = [t.lower().split() for t in texts]
    want = {i for i, x in enumerate(words) if any(x == y or min(len(x), len(y)) >= 5 and near(x, y) for y in words[:i])}
    got = lines.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).where("n_dropped > 0").collect()
    assert {r.doc_id for r in got} == want and len(want) > 80


def test_short_lines_go_when_repeated(spark):
    rows = [(0, "Home page\n\nx y z w\nhome  page"), (1, "HOME page\n\nx y z\na b c d e"), (2, "a b c d\nx y z w\na b c d e f"), (3, "home page")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.text for r in lines.dedup_lines(docs).collect()} == {0: "Home page\n\nx y z w", 1: "\nx y z\na b c d e", 2: "a b c d", 3: ""}
    assert lines.dedup_lines(docs.limit(0)).count() == 0
    import corpus_pipeline as cp

    assert {r.doc_id for r in cp.lines(spark, docs.withColumn("n_chars", F.length("text").cast("long")), SF).collect()} == {0, 1, 2}


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 16))
    x[300:330] = x[300]
    rows = [(i, [float(v) for v in x[i]]) for i in range(600)] + [(601, None), (602, [0.0] * 16), (603, [float("nan")] * 16), (604, [None] * 16), (605, [1.0]), (None, [1.0] * 16), (5, [float(v) for v in x[5]])]
    index = ann.build_index(spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("*", *(F.lit("x").alias(c) for c in ("codes", "norm", "query_id", "score", "n"))))
    got = collections.defaultdict(list)
    for r in ann.search(index, index.vectors.where("vec_id % 100 = 0"), shortlist=64, query_rows=4, block_rows=100).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hits = 0
    for q in range(0, 600, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        best = [i for i in np.lexsort((np.arange(600), d)) if i != q][:10]
        hits += len({v for v, _ in got[q]} & set(best))
        assert all(abs(s - d[v]) < 1e-9 for v, s in got[q])
    assert hits >= 54 and [v for v, _ in got[300]] == list(range(301, 311))
    empty = ann.build_index(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert ann.search(empty, empty.vectors).count() == 0


def test_decontamination(spark, docs, none):
    bench = [("b1", odd_docs()[9][1]), ("b2", "x"), ("b3", None), ("b4", "straße don t"), ("b5", "no such phrase here"), (None, "12 x")]
    b = spark.createDataFrame(bench, "item_id string, text string")
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    split = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = collections.defaultdict(set)
    for item, t in bench:
        w = split(t)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[i : i + 13])] |= {item} - {None}
    want = []
    for r in odd_docs():
        w, hit, items = split(r[1]), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    items |= windows[tuple(w[i : i + n])]
        want.append((r[0], len(w), len(hit), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()))
    for size in (1 << 20, 40):
        got = decontamination.judged(decontamination.find_benchmark(docs, b, block_bytes=size, shard_bytes=size)).select("row.doc_id", "n_words", "n_hit", "items_sha256").collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert decontamination.find_benchmark(none, b).count() == 0
    assert decontamination.judged(decontamination.find_benchmark(docs, b.limit(0))).where("n_hit > 0").count() == 0


def brute_repeats(texts, length):
    seen = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        yield bytes(b for b, g in zip(t, gone) if not g), sum(gone)


@pytest.mark.parametrize("dense", [8192, 1])
def test_repeats(spark, docs, none, dense, monkeypatch):
    monkeypatch.setattr(repeats.repeated_spans, "__defaults__", (200, 32, dense, 1 << 21))
    rng = random.Random(4)
    base = bytes(rng.choices(b"abc", k=900)).decode()
    edited = [base[:k] + "#" + base[k + 1 :] for k in (100, 300, 301, 650)]
    rows = [(r[0], r[1]) for r in odd_docs()] + [(100 + i, t) for i, t in enumerate([base, *edited, "é" * 150, "é" * 99 + base[200:420], base[:199], "z" + base[:200]])]
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(r[0], kept, n) for r, (kept, n) in zip(rows, brute_repeats([(t or "").encode() for _, t in rows], 200))]
    assert sorted(map(str, ((r.doc_id, bytes(r.kept), r.n_removed) for r in got))) == sorted(map(str, want))
    assert repeats.remove_repeats(none).count() == 0


def test_anchors_take_little_memory():
    """A full Arrow batch is anchored in slices, a long text in blocks, and what comes out does not depend on either."""
    import tracemalloc

    import pyarrow as pa

    class Caught:
        select = lambda self, *columns: self
        mapInArrow = lambda self, run, schema: run

    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(97, 123, 2000, np.uint8)) for _ in range(10_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(10_000), pa.int64()), pa.array([7] * 10_000, pa.int64()), pa.array(texts, pa.binary())], names=["t", "tag", "body"])
    run, long = repeats.anchored(Caught(), 200, 32), b"".join(texts[:3000])
    tracemalloc.start()
    rows = sum(b.num_rows for b in run([batch]))
    assert tracemalloc.get_traced_memory()[1] < 20e6
    tracemalloc.reset_peak()
    first, last, anchor, h, _ = repeats.Anchors(200, 32).find(long)
    assert tracemalloc.get_traced_memory()[1] < 250e6
    tracemalloc.stop()
    assert rows == sum(len(repeats.Anchors(200, 32).find(t)[0]) for t in texts)
    assert first[0] == 0 and last[-1] == len(long) - 200 and (first[1:] == last[:-1] + 1).all() and ((first + 168 >= anchor) & (anchor >= last)).all()


def test_sharding(spark, docs, none):
    got = sharding.shard_documents(docs).collect()
    assert len(got) == len(odd_docs())
    real = sharding.op7_hash_tree_sharding(spark, SF).collect()
    slots = collections.defaultdict(list)
    for r in real:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and 0 < sum(r.grown_shard == 16 for r in real) < len(real) / 8
    assert sharding.shard_documents(none).count() == 0
    # sizes, CRC and the descent, draw by draw, in plain Python over XXH64 of the key and the child's name
    texts = {(r.doc_id, r.text): r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    sizes = sorted((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in texts)
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in real) == sizes
    odd = {(r.doc_id, r.size, r.text_crc32) for r in got}
    assert (0, 1, 0) in odd and (3, 2, zlib.crc32(b"x")) in odd

    def draw(key, child):
        h = xxhash.xxh64_intdigest(child.name.encode(), xxhash.xxh64_intdigest(key.encode(), 42))
        return -math.log(((h >> 12) + 0.5) / 2**52) / child.weight

    def descend(key, node):
        while node.shard is None:
            node = min(node.children, key=lambda c: draw(key, c))
        return node.shard

    for r in [*real, *got]:
        key = "\0" if r.doc_id is None else str(r.doc_id)
        assert (r.shard, r.grown_shard) == (descend(key, sharding.tree(16)), descend(key, sharding.tree(17)))


def test_weights_move_documents_into_their_subtree_only(spark):
    rows = spark.range(20_000).select(F.col("id").cast("string").alias("key"))
    leaf = lambda i, w: sharding.Node(f"s{i}", w, (), i)
    grow = lambda w: sharding.branch("root", [sharding.branch("a", [leaf(0, 1.0), leaf(1, w)]), sharding.branch("b", [leaf(2, 1.0), leaf(3, 1.0)])])
    both = rows.select(sharding.descend(F.col("key"), grow(1.0)).alias("x"), sharding.descend(F.col("key"), grow(3.0)).alias("y")).groupBy("x", "y").count().collect()
    moved = {(r.x, r.y): r["count"] for r in both if r.x != r.y}
    assert all(y in (0, 1) and x != y for x, y in moved) and not any(y == 0 and x == 1 for x, y in moved)
    share = collections.Counter()
    for r in both:
        share[r.y] += r["count"]
    assert all(abs(share[i] / 20_000 - w / 6) < 0.02 for i, w in enumerate((1, 3, 1, 1)))


def test_simhash(spark, docs, none):
    prints = [(r.doc_id, r.fp, r.component_id) for r in simhash.near_duplicates(docs).collect()]
    assert len(prints) == len(odd_docs()) and {c for d, f, c in prints if f == 0} == {0}
    assert simhash.near_duplicates(none).count() == 0
    w = WORDS[:6]
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]), 42) for i in range(3)]
    assert simhash.fingerprint_of(" ".join(w).upper().encode()) == sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) > 1.5)
    kept = simhash.one_of_each(with_clashes(docs))
    assert unchanged(kept)
    # one of each group, with an id where any row has one; the copies without an id go
    groups = collections.defaultdict(list)
    for r in simhash.near_duplicates(docs).collect():
        groups[r.component].append(r.doc_id)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(min(d for d in g if d is not None) for g in groups.values())
    nameless = spark.createDataFrame([(None, "a b c d e f")] * 3 + [(None, "zz yy xx ww vv uu tt")], "doc_id long, text string")
    assert sorted(r.text for r in simhash.one_of_each(nameless).collect()) == ["a b c d e f", "zz yy xx ww vv uu tt"]


def plain_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_duplicates_end_to_end(spark):
    """Fingerprints and components of whole documents against a loop over all pairs."""
    rng = random.Random(11)
    texts = [r[1] for r in odd_docs()]
    for _ in range(20):
        base = rng.choices([*WORDS, "Ä", "x" * 30], k=rng.randrange(4, 400))
        for _ in range(4):
            words = list(base)
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            texts.append(rng.choice([" ", "\n", " \t"]).join(words))
    rows = [(7 * n % 101 if n % 17 else None, t) for n, t in enumerate(texts)]
    prints = [plain_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    want = [(d, f"{prints[i]:016x}", least.get(root(i))) for i, (d, _) in enumerate(rows)]
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    got = [(r.doc_id, f"{r.fp % 2**64:016x}", r.component_id) for r in found.collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(set(least.values())) < 0.7 * len(rows)


def test_segments_keep_up_with_the_number_of_fingerprints():
    sizes = [simhash.blocks_for(10**k) for k in range(1, 12)]
    assert sizes[:6] == [6] * 6 and sizes == sorted(sizes) and all(64 * (b - 4) // b >= math.log2(10**k) for k, b in enumerate(sizes, 1))


@pytest.mark.parametrize("dense", [64, 2])
def test_links_join_all_near_fingerprints(spark, dense):
    rng = random.Random(dense)
    points = []
    for _ in range(12):
        p = rng.getrandbits(64)
        for _ in range(8):
            points.append(p)
            for _ in range(rng.randrange(1, 7)):
                p ^= 1 << rng.randrange(64)
    points = sorted(set(points))
    parent = {p: p for p in points}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(points):
        for b in points[:i]:
            if (a ^ b).bit_count() <= 4:
                parent[root(a)] = root(b)
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    from coursefold.llm.components import components

    found = {r.node: r.component for r in components(simhash.links(spark.createDataFrame([(signed(p),) for p in points], "fp long"), dense=dense)).collect()}
    groups = collections.defaultdict(set)
    for p in points:
        groups[root(p)].add(signed(p))
    assert {frozenset(g) for g in groups.values() if len(g) > 1} == {frozenset(n for n in found if found[n] == c) for c in set(found.values())}


def test_revisits(spark):
    schema = "record_id long, url string, ts long, kind string, etag string, last_modified string, headers map<string,string>"
    rows = [
        (1, "http://WWW.a.org:80/x/", 10, "response", "e1", None, {"content-length": "9", "date": "1"}), (2, "https://a.org/x#f", 20, "revisit", "W/e1", None, {"content-length": "0", "date": "2"}),
        (3, "http://a.org/x", 20, "response", "e2", None, None), (4, "http://a.org/x", 300_000, "revisit", "e1", None, None), (5, "http://a.org/x", 5, "revisit", "e1", None, None),
        (6, None, 50, "revisit", "e1", None, None), (7, "http://b.org", 1, "response", None, "m", {}), (8, "http://b.org/", 900_000, "revisit", None, "m", {"age": "1"}),
    ]
    got = {r.record_id: (r.status, r.refers_to, r.headers) for r in revisits.resolve_revisits(spark.createDataFrame(rows, schema)).collect()}
    assert got == {2: ("resolved", 1, {"content-length": "9", "date": "2"}), 4: ("mismatch", 3, None), 5: ("no_earlier", None, None), 6: ("no_earlier", None, None), 8: ("resolved", 7, {"age": "1"})}
    assert revisits.resolve_revisits(spark.createDataFrame([], schema)).count() == 0


def test_canonical_urls(spark):
    same = [("http://www.A.org:80/x/#f", "https://a.org:443/x"), ("HTTP://a.org//", "a.org")]
    other = [("http://a.org:443/x", "https://a.org/x"), ("http://a.org/?q=1/", "http://a.org/?q=1"), ("http://a.org/X", "http://a.org/x"), ("a.org:80", "a.org")]
    df = spark.createDataFrame([(*p, True) for p in same] + [(*p, False) for p in other], "a string, b string, same boolean")
    key = revisits.canonical_url
    assert df.where((key(F.col("a")) == key(F.col("b"))) != F.col("same")).collect() == []
    assert spark.range(1).select(key(F.lit("http://a.org:80/p//?q=/"))).first()[0] == "a.org/p?q=/"


def test_revisits_one_at_a_time(spark):
    """Against a plain search over all responses: ties, repeated rows, null times and URLs, extra columns."""
    rng = random.Random(5)
    pick = lambda *x: rng.choice(x)
    rows = []
    for n in range(300):
        kind = pick("response", "revisit")
        rows.append((n, pick("http://a.org/", "http://b.org/x", "http://b.org/x/", None), pick(None, *range(0, 300_000, 50_000)), kind, pick(None, "e", "W/e", "f"), pick(None, "m1", "m2"), pick(None, {}, {"age": "1", "etag": str(n)})))
    rows += rows[:20]
    bare = lambda t: t.removeprefix("W/")
    url = lambda r: r[1] and r[1].rstrip("/").split("//")[1]
    want = []
    for r in rows:
        if r[3] != "revisit":
            continue
        before = [x for x in rows if x[3] == "response" and url(x) == url(r) and x[2] is not None and r[2] is not None and url(r) and x[2] < r[2]]
        if not before:
            want.append((r[0], "no_earlier", None))
            continue
        of = max(before, key=lambda x: (x[2], x[0]))
        agree = bare(r[4]) == bare(of[4]) if r[4] and of[4] else r[5] is not None and r[5] == of[5]
        want.append((r[0], "resolved" if agree else "mismatch", of[0]))
    df = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, etag string, last_modified string, headers map<string,string>")
    df = df.select("*", *(F.lit("x").alias(c) for c in ("url_key", "span", "found", "last", "carried", "status", "refers_to", "stored", "sent")))
    got = [(r.record_id, r.status, r.refers_to) for r in revisits.resolve_revisits(df, span=100_000).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_language(spark, docs, none):
    got = {(r.row.doc_id, r.row.n_chars): r for r in language.identify(with_clashes(docs), "doc_id", "n_chars").collect()}
    assert got[(0, 1)].lang_pred == got[(1, 1)].lang_pred == got[(10, 1)].lang_pred == "und"
    assert language.identify(none, "doc_id").count() == 0
    found = language.op10_kneser_ney_language(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert found.where("lang = lang_pred").count() >= 0.97 * found.count() > 0


def plain_kneser_ney(texts, grams, text):
    """Mean of -log p of a text under one language's interpolated model, by the formula and over plain dicts.

    ``grams``: the single characters of all languages.
    """
    order = 4
    counts = {n: collections.Counter() for n in range(1, order + 1)}
    for t in texts:
        t = "   " + t
        counts[order].update(t[i : i + order] for i in range(len(t) - order + 1))
    for n in range(order - 1, 0, -1):
        counts[n].update(g[1:] for g in counts[n + 1])
    total, kinds, discount = {}, {}, {}
    for n, c in counts.items():
        total[n], kinds[n] = collections.Counter(), collections.Counter()
        for g, v in c.items():
            total[n][g[:-1]] += v
            kinds[n][g[:-1]] += 1
        once, twice = (sum(v == k for v in c.values()) for k in (1, 2))
        discount[n] = min(max(once / (once + 2 * twice) if once else 0.5, 0.05), 0.95)

    def p(g):
        n = len(g)
        lower = p(g[1:]) if n > 1 else 1 / (1 + grams)
        all_ = total[n][g[:-1]]
        if not all_:
            return lower
        return max(counts[n][g] - discount[n], 0) / all_ + discount[n] * kinds[n][g[:-1]] / all_ * lower

    t = "   " + text
    return -sum(math.log(p(t[i : i + order])) for i in range(len(text))) / len(text)


def test_kneser_ney_by_the_formula():
    own = {"a": ["the cat sat ", "the hat "], "b": ["der hund sass ", "dort der hut "]}
    counts = {lang: collections.Counter(("   " + t)[i : i + 4] for t in ts for i in range(len(t))) for lang, ts in own.items()}
    model = language.KneserNey(counts)
    alphabet = len({c for ts in own.values() for t in ts for c in t})
    for text in ("the cat ", "der ", "zzz the ", "thed sax "):
        got, sizes = model.cross_entropy([text])
        want = [plain_kneser_ney(own[lang], alphabet, text) for lang in model.langs]
        assert sizes[0] == len(text) and np.allclose(got[0], want, atol=1e-5), (text, got, want)


def test_pipeline_stages_on_odd_rows(spark, docs, none):
    import corpus_pipeline as cp

    known = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars", F.lit("h").alias("h"))
    rows = with_clashes(known.limit(40).unionByName(docs.drop("_n").withColumn("doc_id", F.col("doc_id") + 10**9)))
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, rows, SF)
        assert out.columns == rows.columns and unchanged(out), name
        assert stage(spark, rows.limit(0), SF).count() == 0
    assert cp.packed(spark, rows, SF).select("doc_id").distinct().count() == rows.select("doc_id").distinct().count()
    assert cp.packed(spark, rows.limit(0), SF).count() == 0


def test_texts_that_are_not_utf8(spark):
    bad = spark.createDataFrame([(1, b"caf\xe9 \xff\xfe one two three four five"), (2, b"\xff"), (3, b"one two three four five six")], "doc_id long, text binary").select("doc_id", F.expr("cast(text as string)").alias("text"), F.lit("en").alias("lang"))
    assert packing.pack(bad, public_tokenizers.path("word_bpe_49k.json")).agg(F.countDistinct("doc_id")).first()[0] == 3
    assert language.identify(bad, "doc_id").count() == 3 and lines.dedup_lines(bad).count() == 3
    assert scoring.score_documents(bad).count() == 3 and simhash.near_duplicates(bad).count() == 3 and repeats.remove_repeats(bad).count() == 3
    assert decontamination.find_benchmark(bad, bad.select(F.col("doc_id").alias("item_id"), "text")).count() == 3


def test_long_texts_are_read_in_pieces():
    from coursefold.llm.common import pieces

    rng = random.Random(2)
    text = " ".join(rng.choices(WORDS, k=4000)).encode() + b"y" * 5000 + b"\n\tend"
    for most in (1, 7, 1000, 10**6):
        assert b"".join(pieces(text, most)) == text and b" ".join(b" ".join(p.split()) for p in pieces(text, most)).split() == text.split()
        assert simhash.fingerprint_of(text, at_once=most) == simhash.fingerprint_of(text)
    tok = packing.ChunkTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    assert list(tok.ids([text, b"", text], 500)) == list(tok.ids([text, b"", text]))


def test_a_very_long_text(spark):
    """One text of 2 MB, with a line and a word of half a MB each, between short ones."""
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(5000)]
    lines_ = [" ".join(rng.choices(words, k=40)) for _ in range(4000)]
    long = "\n".join([*lines_, " ".join(rng.choices(words, k=90_000)), "w" * 500_000, lines_[5]])
    rows = [(1, "short one here", "en"), (2, long, "en"), (3, lines_[7] + " end", "en"), (4, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    n = len(long.split())
    assert {r.doc_id: r.n_words for r in scoring.score_documents(docs).collect()}[2] == n
    left = {r.doc_id: (r.n_lines, r.n_dropped) for r in lines.dedup_lines(docs).collect()}
    assert left == {1: (1, 0), 2: (4003, 1), 3: (1, 1), 4: (0, 0)}
    hits = decontamination.judged(decontamination.find_benchmark(docs, spark.createDataFrame([("i", lines_[9])], "item_id string, text string")))
    assert {r[0]: (r.n_words, r.n_hit, r.contaminated) for r in hits.select("row.doc_id", "n_words", "n_hit", "contaminated").collect()}[2] == (n, 40, False)
    assert {r.doc_id: r.fp % 2**64 for r in simhash.fingerprints(docs).collect()}[2] == plain_fingerprint(long)
    spans = {r.doc_id: (r.n_bytes, r.n_removed) for r in repeats.remove_repeats(docs).collect()}
    assert spans[2][0] == len(long) and 500_000 <= spans[2][1] < 501_000  # the word repeats itself, a line the one before
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = packing.pack(docs.where("doc_id <> 2 or text is null").unionByName(docs.where("doc_id = 2").withColumn("text", F.substring("text", 1, 1_200_000))), public_tokenizers.path("word_bpe_49k.json"))
    want = len(tok.encode(long[:1_200_000], add_special_tokens=False).ids) + 1
    assert pieces.where("doc_id = 2").agg(F.sum("length"), F.max("doc_tokens")).first() == (want, want)
    assert {r.row.doc_id: r.chars for r in language.identify(docs, "doc_id").collect()}[2] > 1_500_000


def plain_lines(texts):
    """What the line stage leaves of texts by id: each line is compared with all that stand earlier."""
    long, seen, left = collections.defaultdict(list), set(), {}
    for d in sorted(texts):
        split = texts[d].split("\n")
        kept = []
        for line in split:
            words = tuple(re.findall(rb"[^ \t-\r]+", line.encode().lower()))
            n = len(words)
            again = words in seen or n >= 5 and any(one_edit(words, y) for m in (n - 1, n, n + 1) for y in long[m])
            if words and n >= 5 and words not in seen:
                long[n].append(words)
            if words:
                seen.add(words)
            if not again or not words:
                kept.append(line)
        text = "\n".join(kept)
        if len(kept) == len(split) or text.strip(" \t\n\r\x0b\x0c"):
            left[d] = text
    return left


def one_edit(x, y):
    if len(x) > len(y):
        x, y = y, x
    same = next((i for i, (a, b) in enumerate(zip(x, y)) if a != b), len(x))
    return x[same + (len(x) == len(y)) :] == y[same + 1 :]


def test_pipeline(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out, texts = docs, [{r.doc_id: r.text for r in docs.collect()}]
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, out, SF).cache()
        assert out.columns == docs.columns
        texts.append({r.doc_id: r.text for r in out.collect()})
    said = {d: t for d, t in texts[0].items() if any(c.isalpha() for c in t or "")}
    assert texts[1].items() <= said.items() and len(said) - len(texts[1]) <= len(said) // 100
    assert texts[2] == plain_lines(texts[1])
    assert texts[3].items() <= texts[2].items() and texts[4].items() <= texts[3].items()
    kept = {(r.doc_id, r.text) for r in out.collect()}
    packed = cp.packed(spark, out, SF).collect()
    assert {r.doc_id for r in packed} == {d for d, _ in kept}
    bench = decontamination.judged(decontamination.find_benchmark(out, spark.read.parquet(f"{SF}/benchmark.parquet")))
    assert bench.where("contaminated").count() == 0 and out.where(F.col("text").isNull()).count() == 0


def test_shortlists_merge_in_levels(spark):
    rng = random.Random(8)
    rows = [(t, q, t * 100 + i, rng.choice([0.5, 1.5, rng.random()])) for t in range(37) for q in range(3) for i in range(8)]
    short = spark.createDataFrame(rows, "task long, query_id long, vec_id long, near float")
    for at_once in (2, 5, 64):
        got = ann.merged(short, 37, 6, at_once).collect()
        for q in range(3):
            best = sorted((np.float32(n), v) for _, a, v, n in rows if a == q)[:6]
            assert sorted(r.vec_id for r in got if r.query_id == q) == sorted(v for _, v in best)
    best = ann.Shortlists(np.array([7]), np.ones((1, 2), np.float32), [np.zeros((1, 2), np.float32)], 3)
    for ids in ([9, 8, 7], [3, 5], [4]):  # equal estimates from several batches: the least ids stay, the query's own row goes
        best.add(np.array(ids), np.zeros((len(ids), 1), np.uint8), np.ones(len(ids), np.float32))
    assert best.rows[0].tolist() == [3, 4, 5]


def test_samples(spark):
    x = spark.range(5000).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("embedding"))
    hashed = x.select("vec_id", F.shiftrightunsigned(F.xxhash64("vec_id"), 1).alias("h")).orderBy("h", "vec_id").limit(300).collect()
    assert ann.sampled(x, 300, 5000)[:, 0].tolist() == [r.vec_id for r in hashed]
    assert len(ann.sampled(x, 10_000, 5000)) == 5000 and len(ann.sampled(x.limit(0), 10, 0)) == 0
    assert ann.shortlist_rows(0) == ann.shortlist_rows(16_384) == 256 and ann.shortlist_rows(10**6) == 1000


def test_recall_beyond_the_sample(spark):
    """Codebooks fitted to half of the vectors find the neighbours of queries among all of them."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    index = ann.build_index(table, sample_rows=1000)
    asked = index.vectors.where("vec_id % 100 = 0")
    got = {(r.query_id, r.vec_id) for r in ann.search(index, asked, shortlist=100).collect()}  # a twentieth of all rows
    rows = {r.vec_id: r.embedding for r in index.vectors.collect()}
    ids = np.array(sorted(rows))
    x = np.array([rows[i] for i in ids])
    want = set()
    for q in ids[ids % 100 == 0].tolist():
        d = ((x - np.array(rows[q])) ** 2).sum(1)
        want |= {(q, int(v)) for v in [v for v in ids[np.lexsort((ids, d))] if v != q][:10]}
    assert len(got & want) >= 0.9 * len(want)


FOREIGN = [
    "Tämä on suomenkielinen teksti, jota mikään malleista ei ole nähnyt, ja siksi se hylätään kokonaan. " * 3,
    "これは日本語の文章であり、どの言語モデルも学習していないため、拒否されるはずです。" * 4,
    "Это русский текст, которого ни одна из моделей не видела, и поэтому он отвергается. " * 3,
    "xq zvkw jjqp wxzk qqvj zzkx kwvq jxqz " * 8,
    "q" * 300,
]


def test_foreign_texts_are_rejected(spark):
    """Texts of no known language are rejected, and those of known ones are not, though the models have not seen them."""
    known = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    foreign = spark.createDataFrame([(10**7 + i, t, None) for i, t in enumerate(FOREIGN)], known.schema)
    found = language.identify(known.unionByName(foreign), "doc_id").select("row.doc_id", "rejected").collect()
    assert {r.doc_id for r in found if r.rejected} >= {10**7 + i for i in range(len(FOREIGN))}
    ours = [r for r in found if r.doc_id < 10**7]
    assert len(ours) == 1000 and sum(r.rejected for r in ours) <= 5
