"""Operator 11: license scans by template markup.

A template is a license text or notice with regions in ``<<beginOptional>>`` and ``<<endOptional>>``, which may be absent,
and ``<<var;name="..";original="..";match="..">>``, which may be replaced. It is compiled into an automaton over words;
a text is accepted where all of the wording outside such regions stands exactly, word for word. Case (A-Z) and everything
that is no word do not count. Automata are made deterministic as texts need it, and only for texts that hold the longest
run of mandatory words. Phrases, looked for beside them, are words in a row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, table, tidy
from .templates import PHRASES, TEMPLATES, Template

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_MARKUP = re.compile(r"<<(beginOptional|endOptional|var)((?:;\w+=\"[^\"]*\")*)>>")
_ATTRIBUTE = re.compile(r";(\w+)=\"([^\"]*)\"")
SPANS = "array<struct<label:string,first:long,words:int>>"
SCAN = f"n_words long, places {SPANS}, accepted {SPANS}"


def words_of(text: str | bytes) -> list[bytes]:
    return _WORD.findall((text.encode() if isinstance(text, str) else text).lower())


def parsed(markup: str) -> list:
    """A template's sequence of words (bytes), optional sequences ("optional", [...]) and regions ("var", match)."""
    stack, at = [[]], 0
    for m in _MARKUP.finditer(markup):
        stack[-1] += words_of(markup[at : m.start()])
        at = m.end()
        if m[1] == "beginOptional":
            stack.append([])
        elif m[1] == "endOptional":
            if len(stack) == 1:
                raise ValueError("endOptional without beginOptional")
            inner = stack.pop()
            stack[-1].append(("optional", inner))
        else:
            stack[-1].append(("var", dict(_ATTRIBUTE.findall(m[2])).get("match", ".+")))
    if len(stack) > 1:
        raise ValueError("beginOptional without endOptional")
    return [*stack[0], *words_of(markup[at:])]


def alternatives(match: str) -> list[list[bytes]] | None:
    """The word sequences that a region's ``match`` lists, if it is such a list; else each of its words must match it."""
    return [words_of(a) for a in match.split("|")] if re.fullmatch(r"[A-Za-z0-9 |]+", match) else None


class Automaton:
    """A template as a deterministic automaton over words, built as it is used. State 0 is the start, -1 none."""

    def __init__(self, template: Template, limit: int = 100_000):
        self.label, self.base, self.limit = template.label, template.base, limit
        self.most = template.region_words
        self.edges: list[list] = [[]]  # of each inner state: (word, pattern or None for no reading, next)
        self.patterns: list = []
        tree = parsed(template.markup)
        self.final = self._chain(tree, 0)
        self.vocabulary = {w for e in self.edges for w, _, _ in e if w is not None}
        runs, run = [], []
        for x in [*tree, None]:
            if isinstance(x, bytes):
                run.append(x)
            else:
                runs.append(run)
                run = []
        anchor = max(runs, key=len)
        if not anchor:
            raise ValueError(f"{self.label}: a template needs mandatory words")
        self.anchor = b" " + b" ".join(anchor) + b" "
        start = self._closure({0})
        if self.final in start or any(p is not None for s in start for _, p, _ in self.edges[s]):
            raise ValueError(f"{self.label}: a template begins with words")
        self.first = {w for s in start for w, p, _ in self.edges[s] if w is not None}
        self.sets, self.ids, self.accepting, self.next = [start], {start: 0}, [False], {}
        self.classes: dict[bytes, tuple] = {}
        self.span = self._longest()

    def _state(self) -> int:
        self.edges.append([])
        return len(self.edges) - 1

    def _chain(self, tree: list, at: int) -> int:
        for x in tree:
            if isinstance(x, bytes):
                to = self._state()
                self.edges[at].append((x, None, to))
            elif x[0] == "optional":
                to = self._chain(x[1], at)
                if to != at:
                    self.edges[at].append((None, None, to))
            elif (listed := alternatives(x[1])) is not None:
                to = self._state()
                for words in listed:
                    self.edges[self._chain(words, at)].append((None, None, to))
            else:
                pattern, to = re.compile(x[1].encode(), re.DOTALL), self._state()
                self.patterns.append(pattern)
                empty = pattern.fullmatch(b"") is not None
                here = at
                for k in range(self.most):
                    if k or empty:
                        self.edges[here].append((None, None, to))
                    after = self._state()
                    self.edges[here].append((None, len(self.patterns) - 1, after))
                    here = after
                self.edges[here].append((None, None, to))
            at = to
        return at

    def _longest(self) -> int:
        """Words of the longest text that can be accepted: states are made in order, but for joins of branches."""
        far = {0: 0}
        changed = True
        while changed:
            changed = False
            for s, edges in enumerate(self.edges):
                for w, p, to in edges if s in far else ():
                    d = far[s] + (w is not None or p is not None)
                    if d > far.get(to, -1):
                        far[to], changed = d, True
        return far[self.final]

    def _closure(self, states) -> frozenset:
        out, todo = set(states), list(states)
        while todo:
            for w, p, to in self.edges[todo.pop()]:
                if w is None and p is None and to not in out:
                    out.add(to)
                    todo.append(to)
        return frozenset(out)

    def _class(self, word: bytes) -> tuple:
        """What of a word edges can tell apart."""
        if (c := self.classes.get(word)) is None:
            if len(self.classes) >= self.limit:
                self.classes.clear()
            c = self.classes[word] = (word if word in self.vocabulary else None, *(p.fullmatch(word) is not None for p in self.patterns))
        return c

    def _step(self, state: int, c: tuple) -> int:
        if (to := self.next.get((state, c))) is None:
            if len(self.next) >= self.limit:  # begin anew, from the states of now
                self.next.clear()
            reached = {to for s in self.sets[state] for w, p, to in self.edges[s] if (w is not None and w == c[0]) or (p is not None and c[1 + p])}
            found = self._closure(reached) if reached else None
            if found is not None and found not in self.ids:
                self.ids[found] = len(self.sets)
                self.sets.append(found)
                self.accepting.append(self.final in found)
            to = self.next[state, c] = -1 if found is None else self.ids[found]
        return to

    def longest_from(self, words: list[bytes], at: int) -> int:
        """The end of the longest accepted text that begins at word ``at``; 0 for none."""
        state, end = 0, 0
        for i in range(at, len(words)):
            state = self._step(state, self._class(words[i]))
            if state < 0:
                break
            if self.accepting[state]:
                end = i + 1
        return end


@dataclass
class Scanner:
    phrases: dict[str, str]
    templates: list[Template]

    def __post_init__(self):
        self.wanted = [(b" " + b" ".join(w) + b" ", len(w), label) for phrase, label in self.phrases.items() if (w := words_of(phrase))]
        self.automata = [Automaton(t) for t in self.templates]
        self.span = max([1, *(n for _, n, _ in self.wanted), *(a.span for a in self.automata)])

    def scan(self, text: bytes | None, at_once: int = 1 << 20) -> tuple[int, list, list]:
        """(words, places of phrases, accepted texts): (label, first word, number of words) each, in order.

        Texts are taken a piece at a time, with as many words of the piece before as a text can be long. Accepted texts
        of one template do not overlap: the leftmost comes first, and the longest from there.
        """
        places, accepted = [], []
        free = [0] * len(self.automata)
        held: list[bytes] = []
        base = 0  # number of the first word held
        parts = list(pieces(text or b"", at_once)) or [b""]
        for k, part in enumerate(parts):
            held += _WORD.findall(part.lower())
            stop = len(held) if k == len(parts) - 1 else max(0, len(held) - self.span)  # later starts wait for what follows
            joined = b" " + b" ".join(held) + b" "
            for wanted, n, label in self.wanted:
                at = joined.find(wanted)
                i, seen = 0, 0
                while at >= 0:
                    i, seen = i + joined.count(b" ", seen, at), at
                    if i >= stop:
                        break
                    places.append((label, base + i, n))
                    at = joined.find(wanted, at + 1)
            for j, a in enumerate(self.automata):
                if a.anchor not in joined:
                    continue
                for i in [i for i, w in enumerate(held[:stop]) if w in a.first]:
                    if base + i >= free[j] and (end := a.longest_from(held, i)):
                        accepted.append((a.label, base + i, end - i))
                        free[j] = base + end
            base += stop
            held = held[stop:]
        order = lambda x: (x[1], x[0], x[2])
        return base, sorted(places, key=order), sorted(accepted, key=order)


def scan_licenses(docs: DataFrame, templates: list[Template] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """One row per document: doc_id, n_words, ``places`` of phrases and ``accepted`` texts (label, first word, words).

    Null and empty texts have no words. Repeated rows and null ids are kept. Texts are scanned a MB at a time, so a very long
    one takes no more memory but for what is found in it. Further columns are ignored. An empty table gives no rows.
    """
    Scanner(phrases, templates)  # an error in a template is raised here

    def run(batches):
        import pyarrow as pa

        scanner, spans = Scanner(phrases, templates), pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("words", pa.int32())]))
        dicts = lambda found: [{"label": a, "first": b, "words": c} for a, b, c in found]
        for batch in batches:
            rows = [scanner.scan(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _, _ in rows], pa.int64()), pa.array([dicts(p) for _, p, _ in rows], spans), pa.array([dicts(a) for _, _, a in rows], spans)], names=["doc_id", "n_words", "places", "accepted"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(tidy(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {SCAN}")


def judged(scanned: DataFrame, templates: list[Template] = TEMPLATES) -> DataFrame:
    """``scanned`` with ``base_labels``, ``labels`` and ``score``, all from its labels.

    An accepted text confirms the base label of its template. The score is the mean over accepted labels, which count 1,
    and base labels that none of them confirms, which count 1/2: they may be no more than a mention. Without labels it is 0.
    """
    of = lambda c: F.array_sort(F.array_distinct(F.transform(c, lambda x: x["label"])))
    bases = F.map_from_arrays(F.array(*(F.lit(t.label) for t in templates)), F.array(*(F.lit(t.base) for t in templates))) if templates else F.create_map()
    confirmed: Column = F.transform("_own", lambda x: bases[x])
    a, u = F.size("_own"), F.size(F.array_except("_base", confirmed))
    rows = scanned.withColumns({"_base": of("places"), "_own": of("accepted")})
    rows = rows.withColumn("score", F.when(a + u > 0, (a + F.lit(0.5) * u) / (a + u)).otherwise(F.lit(0.0)))
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    return rows.withColumns({"base_labels": joined(F.col("_base")), "labels": joined(F.array_union("_base", "_own"))}).drop("_base", "_own")


def op11_template_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(scan_licenses(table(spark, sf_dir, "documents")))
    first = F.transform("places", lambda x: x["first"])
    return rows.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(first).alias("first_word"), F.array_max(first).alias("last_word"), "base_labels", "labels", "score")


def as_pattern(template: Template) -> str:
    """The same language as a regular expression over words, each after a blank: what SQL and tests compare with."""

    def part(tree) -> str:
        out = ""
        for x in tree:
            if isinstance(x, bytes):
                out += " " + x.decode()
            elif x[0] == "optional":
                out += f"(?:{part(x[1])})?"
            elif (listed := alternatives(x[1])) is not None:
                out += "(?:" + "|".join("".join(f" {w.decode()}" for w in a) for a in listed) + ")"
            else:
                least = 0 if re.fullmatch(x[1], "") else 1
                one = "[^ ]+" if x[1] in (".+", ".*") else f"(?:{x[1]})"
                out += f"(?: {one}){{{least},{template.region_words}}}"
        return out

    return part(parsed(template.markup)) + " "


def _sql() -> str:
    found = ",\n  ".join(f"CASE WHEN regexp_matches(j, '{as_pattern(t)}') THEN '{t.label}' END" for t in TEMPLATES)
    bases = ", ".join(f"'{t.label}': '{t.base}'" for t in TEMPLATES)
    at = []
    for phrase, label in PHRASES.items():
        same = " AND ".join(f"ws[i + {k + 1}] = '{w.decode()}'" for k, w in enumerate(words_of(phrase)))
        at.append(f"list_transform(list_filter(range(len(ws)), lambda i: {same}), lambda i: {{'i': i, 'l': '{label}'}})")
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
p AS (SELECT doc_id, len(ws) AS n_words, ' ' || array_to_string(ws, ' ') || ' ' AS j, list_concat({', '.join(at)}) AS ps FROM d),
f AS (SELECT *, list_distinct(list_transform(ps, lambda x: x.l)) AS b, list_distinct(list_filter([
  {found}], lambda x: x IS NOT NULL)) AS o FROM p),
s AS (SELECT *, len(o) AS a, len(list_filter(b, lambda x: NOT list_contains(list_transform(o, lambda y: MAP {{{bases}}}[y]), x))) AS u FROM f)
SELECT doc_id, n_words, len(ps) AS n_base, list_min(list_transform(ps, lambda x: x.i)) AS first_word, list_max(list_transform(ps, lambda x: x.i)) AS last_word,
  array_to_string(list_sort(b), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(b, o))), ',') AS labels,
  CASE WHEN a + u = 0 THEN 0.0::DOUBLE ELSE (a + 0.5::DOUBLE * u) / (a + u) END AS score
FROM s
"""

OP11_SQL = _sql()
