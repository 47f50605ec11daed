"""Operator 1: bounded-space online packing of token sequences.

Each task streams its documents through a fixed number of open windows. A piece goes to the window
that it fills best; if it fits none and all windows are taken, the fullest window is emitted. What
stays open at the end of a task is merged with the leftovers of a bounded number of other tasks.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HELD, materialize, pieces, table, tidy

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
OPEN = PIECES + ", batch int, ids binary"

#: Letters of Latin-1 with ASCII marks after them (no apostrophe: it starts suffixes of its own).
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


class ChunkTokenizer:
    """Token ids of a text as little-endian 32-bit integers.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its
    chunks between ASCII white space. Ids of ``limit`` chunks and of twice as many parts of chunks are
    remembered, and those of one more block of text.
    """

    def __init__(self, path: str, limit: int = 200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.model = self.tokenizer.model
        self.chunks: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {"": b""}
        # the byte-level alphabet of the model; printable ASCII stands for itself
        self.letters = {i: self._byte(i) for i in range(0xC0, 0x100)}

    @staticmethod
    def _byte(code: int) -> str:
        """A letter of Latin-1 as its two UTF-8 bytes in the model's alphabet, which moves 0x80-0xA0 and 0xAD up."""
        moved = [*range(33), *range(127, 161), 173]
        return "".join(chr(256 + moved.index(b) if b in moved else b) for b in chr(code).encode())

    def _part(self, part: str) -> bytes:
        got = self.parts.get(part)
        if got is None:
            got = self.parts[part] = b"".join(x.id.to_bytes(4, "little") for x in self.model.tokenize(part if part.isascii() else part.translate(self.letters)))
        return got

    def learn(self, texts: list[list[bytes]]) -> None:
        import numpy as np

        if len(self.chunks) > self.limit:
            self.chunks.clear()
        if len(self.parts) > 2 * self.limit:
            self.parts = {"": b""}
        new: set[bytes] = set()
        for chunks in texts:
            new.update(chunks)
        new -= self.chunks.keys()
        rest = []
        for c in new:
            # letters with marks after them are two words to the tokenizer, whatever their case
            if m := _PLAIN.fullmatch(c.decode("utf-8", "replace")):
                self.chunks[c] = self._part(m[1].lower()) + self._part(m[2])
            else:
                rest.append(c)
        for at in range(0, len(rest), 20_000):
            some = rest[at : at + 20_000]
            for c, e in zip(some, self.tokenizer.encode_batch_fast([c.decode("utf-8", "replace") for c in some], add_special_tokens=False)):
                self.chunks[c] = np.array(e.ids, "<u4").tobytes()

    def ids(self, texts: list[bytes], at_once: int = 1 << 22) -> Iterator[bytes]:
        """Each text's ids. About ``at_once`` bytes of text are split at a time: chunks take ten times their text's room."""
        ends = [0, *accumulate(map(len, texts))]
        at = 0
        while at < len(texts):
            to = max(at + 1, bisect_left(ends, ends[at] + at_once))
            if to > at + 1:
                yield from self._of([t.split() for t in texts[at:to]])
            else:  # one text may be longer than that
                yield b"".join(x for piece in pieces(texts[at], at_once) for x in self._of([piece.split()]))
            at = to

    def _of(self, split: list[list[bytes]]) -> Iterator[bytes]:
        self.learn(split)
        get = self.chunks.__getitem__
        return (b"".join(map(get, chunks)) for chunks in split)


class OpenWindows:
    """At most ``most`` windows of ``size`` tokens. ``emit(sequence, pieces)`` gets each closed one."""

    def __init__(self, size: int, most: int, least_cut: int):
        self.size, self.most, self.least_cut = size, most, least_cut
        self.gaps: list[tuple[int, int]] = []
        self.held: dict[int, list] = {}
        self.count = 0

    def _close(self, at: int) -> list:
        _, window = self.gaps.pop(at)
        return self.held.pop(window)

    def place(self, doc: tuple, start: int, length: int) -> Iterator[list]:
        """Put tokens [start, start + length) of ``doc`` somewhere; yields the windows that this closes."""
        while length:
            at = bisect_left(self.gaps, (min(length, self.size), -1))
            if at == len(self.gaps) and len(self.gaps) == self.most:
                gap = self.gaps[0][0]  # the fullest
                if gap >= self.least_cut:
                    self.held[self.gaps[0][1]].append((doc, start, gap))
                    start, length = start + gap, length - gap
                yield self._close(0)
                continue
            take = min(length, self.size)
            if at < len(self.gaps):
                gap, window = self.gaps.pop(at)
            else:
                gap, window = self.size, self.count
                self.count += 1
                self.held[window] = []
            self.held[window].append((doc, start, take))
            insort(self.gaps, (gap - take, window))
            if gap == take:
                yield self._close(0)
            start, length = start + take, length - take


def _rows(sequence: int, held: list, batch: int | None = None) -> Iterator[tuple]:
    offset = 0
    for (doc_id, ids), start, length in held:
        cut = ids[4 * start : 4 * (start + length)]
        yield doc_id, start, length, zlib.crc32(cut), len(ids) // 4, sequence, offset, batch, None if batch is None else cut
        offset += length


def _merge(held: list[list], size: int, least_cut: int) -> list[list]:
    """Leftover windows, each a list of [piece row, ids], packed again: best fit by falling length."""
    gaps: list[tuple[int, int]] = []
    out: list[list] = []
    for piece in sorted((p for w in held for p in w), key=lambda p: (-p[3], p[0] is None, p[0] or 0, p[1])):
        at = bisect_left(gaps, (piece[3], -1))
        if at < len(gaps):
            gap, w = gaps.pop(at)
        else:
            gap, w = size, len(out)
            out.append([])
        out[w].append(piece)
        insort(gaps, (gap - piece[3], w))
    # the emptiest windows are cut up to fill the others
    order = [w for _, w in gaps]
    free = {w: g for g, w in gaps}
    lo, hi = 0, len(order) - 1
    while lo < hi:
        a, b = order[lo], order[hi]
        if free[a] < least_cut:
            lo += 1
            continue
        if not out[b]:
            hi -= 1
            continue
        doc, start, total, length, ids = out[b].pop()
        take = min(length, free[a])
        out[a].append((doc, start, total, take, ids[: 4 * take]))
        if take < length:
            out[b].append((doc, start + take, total, length - take, ids[4 * take :]))
        free[a] -= take
        free[b] += take
    # a last part-filled window becomes sequences whose lengths are powers of two, which need no padding
    done: list[list] = []
    for w in order:
        used = size - free[w]
        if free[w] < least_cut or not used:
            done += [out[w]] * bool(used)
            continue
        rest = list(reversed(out[w]))
        while used:
            want = part = 1 << (used.bit_length() - 1)
            now = []
            while want:
                doc, start, total, length, ids = rest.pop()
                take = min(length, want)
                now.append((doc, start, total, take, ids[: 4 * take]))
                if take < length:
                    rest.append((doc, start + take, total, length - take, ids[4 * take :]))
                want -= take
            done.append(now)
            used -= part
    return done


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 2, size: int = 4096, open_windows: int = 64, least_cut: int = 16, fan_in: int = 8) -> DataFrame:
    """Pieces of all documents, each with its place in a sequence of at most ``size`` tokens.

    A document is its text's ids and then ``end_id``, so a null or empty text is one token. A piece
    shorter than ``least_cut`` is not cut off to fill a window; that much padding stays instead.
    ``fan_in`` tasks' leftovers are merged together, ``fan_in * open_windows * size`` tokens at most.
    Repeated rows are packed once each, null keys too; an empty table gives no rows, and further
    columns are ignored. Long texts are split a few MB at a time. Bytes that are not UTF-8 are read as U+FFFD.
    """
    spark = docs.sparkSession

    def tasks(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        tok = tokenizer_of(tokenizer)
        windows, sequence = OpenWindows(size, open_windows, least_cut), pid << 32
        end = np.array([end_id], "<u4").tobytes()
        schema = pa.schema([*((n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")), ("batch", pa.int32()), ("ids", pa.binary())])
        rows: list[tuple] = []

        def out():
            cols = list(zip(*rows)) or [()] * len(schema)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

        for batch in batches:
            for part in (batch.slice(at, 1000) for at in range(0, batch.num_rows, 1000)):
                for doc_id, body in zip(part.column(0).to_pylist(), tok.ids([t or b"" for t in part.column(1).to_pylist()])):
                    body += end
                    for closed in windows.place((doc_id, body), 0, len(body) // 4):
                        rows.extend(_rows(sequence, closed))
                        sequence += 1
                yield out()
                rows.clear()
        for held in windows.held.values():
            rows.extend(_rows(sequence, held, pid // fan_in))
            sequence += 1
        yield out()

    def merge(key, pdf):
        import pandas as pd

        held: dict[int, list] = {}
        for r in pdf.sort_values(["sequence_id", "offset"]).itertuples(index=False):
            held.setdefault(r.sequence_id, []).append((None if pd.isna(r.doc_id) else int(r.doc_id), r.start, r.doc_tokens, r.length, r.ids))
        rows = []
        for n, window in enumerate(_merge([held[k] for k in sorted(held)], size, least_cut)):
            offset = 0
            for doc, start, total, length, ids in window:
                rows.append((doc, start, length, zlib.crc32(ids), total, (1 << 62) + (int(key[0]) << 32) + n, offset))
                offset += length
        out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
        return out.astype({"doc_id": "Int64"})

    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    placed = materialize(narrow.mapInArrow(tidy(tasks, "tokenizers"), OPEN))  # tokenized once for both uses
    closed = placed.where("batch is null").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    return closed.unionByName(placed.where("batch is not null").groupBy("batch").applyInPandas(merge, PIECES))


_TOKENIZERS: dict[str, ChunkTokenizer] = {}
HELD["tokenizers"] = _TOKENIZERS


def tokenizer_of(path: str) -> ChunkTokenizer:
    """One for each Python worker, so that what it remembers serves the worker's next task."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = ChunkTokenizer(path)
    return _TOKENIZERS[path]


def op1_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
