"""Operators 11 to 13 against plain versions."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from coursefold.llm import codes, licenses, phrases
from coursefold.llm.templates import PHRASES, TEMPLATES, Template

VECTORS = "vec_id long, embedding array<double>, label int, codes string, near string, error string, _label string, slot int"


def plain_codes(rows, parts=16, entries=64, rounds=2):
    """Every part compared with every entry in every round, in Python integers."""
    kept = [(i, [math.floor(256 * x) if abs(x) < 2**60 else int(x) * 256 for x in v], label, v) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    size = collections.Counter(len(k[1]) for k in kept)
    d = min(size, key=lambda n: (-size[n], n)) if size else 0
    kept = [k for k in kept if len(k[1]) == d]
    cuts = [d * p // parts for p in range(parts + 1)]
    cut = lambda v: [tuple(v[a:b]) for a, b in zip(cuts, cuts[1:])]
    seeds = sorted(kept, key=lambda k: (k[0] is None, k[0] or 0, k[3]))[:entries]
    books = [[cut(s[1])[p] for s in seeds] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for k in kept:
            for p, x in enumerate(cut(k[1])):
                groups[p, nearest(p, x)[1]].append(x)
        for (p, i), xs in groups.items():
            books[p][i] = tuple(sum(c) // len(xs) for c in zip(*xs))
    out = []
    for i, v, label, _ in kept:
        best = [nearest(p, x) for p, x in enumerate(cut(v))]
        out.append((i, label, "".join(f"{e:02x}" for _, e in best), min(codes.MOST, sum(x for x, _ in best))))
    return out, hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()


def coded(spark, rows, **options):
    df = spark.createDataFrame([(*r, None, None, None, None, None) for r in rows], VECTORS).repartition(3)
    found, lloyd = codes.compress(df, "label", **options)
    return sorted(((r.vec_id, r.label, r.codes.hex(), r.error) for r in found.collect()), key=str), lloyd.digest()


def test_codes(spark):
    rng = random.Random(4)
    vec = lambda: [rng.choice([-2, -1, 0, 1, 2]) * 0.3 + rng.random() * 0.01 for _ in range(32)]
    rows = [(i, vec(), i % 3) for i in range(300)]
    rows += [(7, rows[7][1], 1), (7, rows[7][1], 1), (None, rows[9][1], None), (900, [0.0] * 32, None)]  # repeated, nameless, zero
    odd = [(400, None, 1), (401, [], 1), (402, [None] + [0.1] * 31, 1), (403, [math.nan] + [0.1] * 31, 1), (404, [math.inf] * 32, 1), (405, [0.5] * 31, 1)]
    want, digest = plain_codes(rows + odd, entries=20, rounds=4)
    assert coded(spark, rows + odd, entries=20, rounds=4) == (sorted(want, key=str), digest)
    large = rows[:40] + [(500, [3.0e30] * 32, 1), (501, [-3.0e30] * 32, 1), (502, [7.0e6, -8.0e6] * 16, 1), (3, [1.0e9] * 32, 2)]
    want, digest = plain_codes(large, entries=6, rounds=3)
    assert coded(spark, large, entries=6, rounds=3) == (sorted(want, key=str), digest)
    want, digest = plain_codes([(i, v[:21], n) for i, v, n in rows], entries=9, rounds=2)  # parts of different widths
    assert coded(spark, [(i, v and v[:21], n) for i, v, n in rows], entries=9, rounds=2) == (sorted(want, key=str), digest)
    assert coded(spark, odd[:5]) == ([], hashlib.sha256(b"").hexdigest())


def test_label_errors(spark):
    rows = spark.createDataFrame([(1, None, 5), (2, None, 6), (3, 1, 7), (4, 1, codes.MOST)], "vec_id long, label int, error long")
    for most in (100, 1):  # sent to all, and joined
        got = {r.vec_id: r.label_error for r in codes.by_label(rows, "label", most).collect()}
        assert got == {1: 11, 2: 11, 3: codes.MOST, 4: codes.MOST}


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_moved_entries_only(data):
    """Comparing moved entries only gives what a whole scan gives, ties included."""
    rng = np.random.default_rng(data.draw(st.integers(0, 10**6)))
    big = data.draw(st.sampled_from([3, 10**5, 10**9, 10**20]))
    draw = lambda n: np.array([[int(v) * (big // 3) for v in r] for r in rng.integers(-3, 4, (n, 3))], object if big > 2**60 else np.int64)
    x, entries = draw(50), draw(9)
    code, near = codes.nearest(x, entries)
    moved = rng.random(9) < 0.4
    later = entries.copy()
    later[moved] = draw(9)[moved]
    got = codes.nearest(x, later, code, near, moved)
    want = codes.nearest(x, later)
    assert got[0].tolist() == want[0].tolist() and list(map(int, got[1])) == list(map(int, want[1]))


def plain_scan(text):
    """Places by a loop over words; labels by regular expressions over all words."""
    words = licenses.words_of(text or "")
    places = sorted((i, label, len(w)) for p, label in PHRASES.items() for w in [licenses.words_of(p)] for i in range(len(words)) if words[i : i + len(w)] == w)
    joined = b" " + b" ".join(words) + b" "
    return len(words), [(label, i, n) for i, label, n in places], {t.label for t in TEMPLATES if re.search(licenses.as_pattern(t).encode(), joined)}


PARTS = [
    "Released under the MIT License.", "licensed under the terms of the mit license", "Licensed under the MITs License", "released under the, MIT: LICENSE",
    "This work is licensed under the GNU General Public License, version 3.", "GNU General Public License gnu general public license", "cc by cc by", "CC-BY 4.0",
    "Licensed under CC BY-NC 4.0.", "shared under a Creative Commons Attribution 4.0 International license", "Licensed under the Apache License, Version 2.0", "apache license 2.0",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
    "either version 3 of the License, or (at your option) any later version.", "İ mit lıcense ÄMIT licenseß", "under the", "the", "42",
]
MIT = TEMPLATES[1]


def filled(template, rng):
    """A text of the template: regions at random."""

    def some(tree):
        for x in tree:
            if isinstance(x, bytes):
                yield x.decode().upper() if rng.random() < 0.3 else x.decode()
            elif x[0] == "optional":
                if rng.random() < 0.5:
                    yield from some(x[1])
            elif listed := licenses.alternatives(x[1]):
                yield " ".join(w.decode() for w in rng.choice(listed))
            else:
                yield from ["any", "owner", "2024"][: rng.randint(1, 3)]

    return " ".join(some(licenses.parsed(template.markup)))


def test_licenses(spark):
    rng, scanner = random.Random(2), licenses.Scanner(PHRASES, TEMPLATES)
    texts = [None, "", "  .. ", *PARTS, *(" ".join(rng.choices(PARTS, k=rng.randint(1, 9))) for _ in range(200))]
    texts += [filled(t, rng) for t in TEMPLATES for _ in range(4)]
    for t in TEMPLATES:  # a word changed outside of regions is no match
        words = filled(t, rng).split()
        texts += [" ".join([*words[:i], "other", *words[i + 1 :]]) for i in (len(words) - 1, len(words) // 2)]
    for text in texts:
        n, places, accepted = scanner.scan(text and text.encode())
        assert (n, places, {label for label, _, _ in accepted}) == plain_scan(text)
    for t in TEMPLATES:
        text = "before it " + filled(t, rng) + " and after"
        assert (t.label, 2) in [(label, first) for label, first, _ in scanner.scan(text.encode())[2]]
    long = " ".join([*texts[40:], "word " * 3000, filled(MIT, rng), "CC BY " * 50, "x" * 5000, *PARTS] * 3)
    for at_once in (100, 1000, 4096):  # pieces give what the whole text gives
        assert scanner.scan(long.encode(), at_once) == scanner.scan(long.encode())
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, PARTS[0], "x"), (1, PARTS[0], "y"), (1, PARTS[0], "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, places string").repartition(3)
    got = licenses.judged(licenses.scan_licenses(docs)).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got if r.doc_id != 1}
    bases = {t.label: t.base for t in TEMPLATES}
    for i, text, _ in rows:
        if i == 1:
            continue
        n, places, labels = plain_scan(text)
        base = {label for label, _, _ in places}
        loose = base - {bases[x] for x in labels}
        r = by_id[i]
        assert (r.n_words, len(r.places), r.base_labels, r.labels) == (n, len(places), ",".join(sorted(base)), ",".join(sorted(base | labels)))
        assert r.score == ((len(labels) + 0.5 * len(loose)) / (len(labels) + len(loose)) if labels or loose else 0)
    assert licenses.scan_licenses(docs.limit(0)).count() == 0


def test_markup():
    for bad in ("<<beginOptional>>a", "a<<endOptional>>", "<<beginOptional>>only<<endOptional>>", '<<var;name="x";match=".+">> end', ""):
        with pytest.raises(ValueError):
            licenses.Automaton(Template("x", "", bad))
    a = licenses.Automaton(Template("x", "", 'a <<var;name="n";match="[0-9]*">> b', 3))
    ends = lambda text: a.longest_from(licenses.words_of(text), 0)
    assert [ends(t) for t in ("a b", "a 1 b", "a 1 2 3 b", "a 1 2 3 4 b", "a x b", "b")] == [2, 3, 5, 0, 0, 0]
    a = licenses.Automaton(Template("x", "", "a <<beginOptional>>b <<beginOptional>>c<<endOptional>> d<<endOptional>> e"))
    assert [ends(t) for t in ("a e", "a b d e", "a b c d e", "a b e", "a c e")] == [2, 4, 5, 0, 0]


def plain_phrases(rows, threshold, inside=50, most=2000):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    found = []
    for (lang, p), a in f.items():
        if len(p) < 2 or a < threshold:
            continue
        if len(p) == 2 and any(x == lang and len(q) == 3 and b >= threshold and p in (q[:2], q[1:]) and 100 * b >= inside * a for (x, q), b in f.items()):
            continue
        score, _, left, right = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        found.append((lang, -score, -a, " ".join(p).encode(), left, right))
    out, rank = [], collections.Counter()
    for lang, score, a, p, left, right in sorted(found):
        rank[lang] += 1
        if rank[lang] <= most:
            out.append((lang, rank[lang], p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def test_phrases(spark):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice(["a", "B", "b", "ç", "dd", "x\x00y", " ", "e"]) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", " ", "\r\n", "\x0b"]) for _ in range(n))
    rows = [(text(rng.randint(0, 60)), rng.choice(["en", "en", "en", "fr", None, "und", ""])) for _ in range(150)]
    rows += [(None, "en"), ("", "fr"), (" .. \n", None), ("a a a a a", "en"), ("same words here again", "de")] + [("same words here again", "de")] * 20
    rows += [(text(4000), "en"), (" ".join(["one two three four"] * 900), "xx"), ("z" * 3000 + " end of it" * 5, "en")]
    docs = spark.createDataFrame([(i, t, lang, "clash", 1) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string, phrase string, k int").repartition(5)
    columns = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    for threshold, most, block in ((10, 2000, 2000), (3, 15, 500)):
        got = sorted(tuple(r[c] for c in columns) for r in phrases.collocations(docs, threshold, most=most, block_bytes=block, salts=3).collect())
        assert got == plain_phrases(rows, threshold, most=most) and got
    assert phrases.collocations(docs.limit(0)).count() == 0


def test_texts_in_pieces(monkeypatch):
    """Blocks of pieces count what whole texts do, wherever texts and blocks are cut."""
    import pyarrow as pa
    import pyspark

    class Task:
        partitionId = staticmethod(lambda: 0)

    monkeypatch.setattr(pyspark.TaskContext, "get", staticmethod(lambda: Task))
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice(["ab", "c", "d", "é", "f" * 40]) + rng.choice([" ", " ", "  ", "\t", " . ", "\n"]) for _ in range(n)).encode()
    rows = [(text(600), "en"), (text(9), "fr"), (None, "en"), (b"", "fr"), (text(300), "fr"), (b"a" * 500 + b" b" * 300, "en")]
    batch = pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows], pa.binary()), pa.array([x for _, x in rows])], names=["text", "lang"])

    def counted(size, at_once):
        total = collections.Counter()
        for _, block in phrases.blocks([batch], size, at_once):
            g = phrases.Grams(block)
            for lang, n, p, c in zip(*g.spell(np.ones(len(g.order), bool))):
                total[lang, n, p] += c
            total.update({(lang, 0, None): c for lang, c in g.words.items()})
        return +total

    whole = counted(1 << 20, 1 << 20)
    assert whole["en", 2, b"b b"] == 299
    for size, at_once in ((1 << 20, 1), (1, 1), (100, 7), (333, 50), (1000, 333)):
        assert counted(size, at_once) == whole


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 9)), max_size=30), max_size=8), st.integers(1, 30))
def test_summary(streams, threshold):
    """However summaries are merged, no item that reaches the threshold is lost, and counters are bounds."""
    true = collections.Counter()
    for s in streams:
        for item, c in s:
            true[item] += c
    capacity = sum(true.values()) // threshold + 1
    parts = []
    for s in streams:
        x = phrases.Summary(capacity)
        for item, c in s:
            x.add(np.array([item], np.uint64), np.array([c]))
        parts.append(x)
    whole = phrases.Summary(capacity)
    for x in parts:
        whole.add(x.items, x.counts, x.lost)
    assert whole.lost < threshold and len(whole.items) <= capacity
    assert {i for i, c in true.items() if c >= threshold} <= set(whole.frequent(threshold).tolist())
    for i, c in zip(whole.items.tolist(), whole.counts.tolist()):
        assert c <= true[i] <= c + whole.lost
