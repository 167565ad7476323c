"""Substring dedup: words of 50-word windows that an earlier document has too are removed.

Method: a count-min sketch over all windows comes first. Each block of documents makes its own sketch (sparse: the
sorted cells that its windows hit, with a mark where it hits one twice), the sketches of all blocks are merged by
adding counters range by range, and each block learns for its cells whether the sum is two or more. Sums only
overestimate, so a window found in two documents is never lost. The second pass groups exactly (96-bit hashes of
the words) only the windows estimated as repeated and finds their smallest document.

Both passes are one exchange of questions and answers: a block asks each range of cells (or hashes) once, with its
distinct values packed to a few bits or bytes each, and gets one bit per value back. So a window that a third of
all documents share costs one question per block, no range holds more than its share of distinct values, and the
sketch grows with the data (four to eight cells per window and row) without ever being in one place.

Defined cases: null or empty texts and texts under 50 words lose nothing; repeats inside one document are no
repeats; rows that repeat a doc_id are each judged against smaller ids only; a null id comes after all others.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtrace.llm import core
from fieldtrace.llm.registry import query

WINDOW = 50
BLOCK_BYTES = 4 << 20  # text of a block of documents
RANGE_BYTES = 16 << 20  # text whose windows fall into one range of cells
_ROWS = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))  # odd factors: the rows of the sketch
_SECOND = np.uint64(0x2545F4914F6CDD1D)

_QUESTION = "block long, step int, part long, marks binary, more binary"
_ANSWER = "block long, step int, part long, bits binary"


class _Block:
    """The documents of one block in a fixed order, with the hashes of all their windows."""

    def __init__(self, table: pa.Table, window: int):
        doc, data = core.ids(table), [x or b"" for x in table.column("data").to_pylist()]
        order = sorted(range(len(data)), key=lambda i: (doc[i], data[i]))
        self.doc, self.data = doc[order], [data[i] for i in order]
        self.words = [x.split() for x in self.data]
        self.lengths = np.array([len(x) for x in self.words], np.int64)
        base = core.hash_words([w for x in self.words for w in x])
        self.at = core.spans(self.lengths, window)
        self.owner = core.owners(self.lengths)
        self.hash = core.rolling(base, window)[self.at] if len(self.at) else np.zeros(0, np.uint64)
        self._base, self._window = base, window

    def second(self, which: np.ndarray) -> np.ndarray:
        """Independent 32 bits for some windows."""
        if not len(which):
            return np.zeros(0, np.uint32)
        return (core.rolling(self._base ^ _SECOND, self._window)[self.at[which]] >> np.uint64(32)).astype(np.uint32)

    def cells(self, row: int, bits: int):
        """Distinct cells in order, for each window its place among them, and which are hit twice."""
        cell = (self.hash * _ROWS[row]) >> np.uint64(64 - bits)
        values, inverse, counts = np.unique(cell, return_inverse=True, return_counts=True)
        return values, inverse, counts > 1

    def repeated(self, bits: int, part_bits: int, answers: dict) -> np.ndarray:
        """Windows whose estimate is two or more in both rows."""
        keep = np.ones(len(self.at), bool)
        for row in range(2):
            values, inverse, _ = self.cells(row, bits)
            keep &= _flags(values >> np.uint64(bits - part_bits), row, answers)[inverse]
        return np.flatnonzero(keep)

    def distinct(self, which: np.ndarray):
        """Distinct windows among ``which``: hash, second hash, smallest document, and each one's place among them."""
        h, g, d = self.hash[which], self.second(which), self.owner[self.at[which]]
        order = np.lexsort((d, g, h))
        new = np.ones(len(order), bool)
        new[1:] = (h[order[1:]] != h[order[:-1]]) | (g[order[1:]] != g[order[:-1]])
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        first = order[new]
        return h[first], g[first], d[first], place


def _cuts(part: np.ndarray):
    """(part, from, upto) of runs of equal numbers in order."""
    if len(part):
        edges = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]])
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield int(part[a]), int(a), int(b)


def _flags(part: np.ndarray, step: int, answers: dict) -> np.ndarray:
    out = np.zeros(len(part), bool)
    for p, a, b in _cuts(part):
        out[a:b] = np.unpackbits(np.frombuffer(answers[step, p], np.uint8), count=b - a)
    return out


def _question_rows(rows: list) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [[]] * 5
    return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary()), pa.array(cols[4], pa.binary())],
                    names=["block", "step", "part", "marks", "more"])


def _answer_rows(rows: list) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary())],
                    names=["block", "step", "part", "bits"])


def _answers(table: pa.Table) -> dict:
    return {(s, p): b for s, p, b in zip(table.column("step").to_pylist(), table.column("part").to_pylist(), table.column("bits").to_pylist(), strict=True)}


def _sketch(window: int, bits: int, part_bits: int):
    """Pass one, asking: the cells of a block's windows, by range."""

    def ask(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        block, rows = _Block(table, window), []
        for row in range(2):
            values, _, twice = block.cells(row, bits)
            for p, a, b in _cuts(values >> np.uint64(bits - part_bits)):
                offsets = values[a:b] - np.uint64(p << (bits - part_bits))
                rows.append((key[0].as_py(), row, p, core.pack(offsets, 1 << (bits - part_bits)), np.packbits(twice[a:b]).tobytes()))
        return _question_rows(rows)

    return ask


def _merge(width: int):
    """Pass one, answering: counters of one range, saturated at two, from all blocks."""

    def answer(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        counters = np.zeros(width, np.uint8)
        asked = [(b, core.unpack(m).astype(np.int64)) for b, m in zip(table.column("block").to_pylist(), table.column("marks").to_pylist(), strict=True)]
        for (_, cells), more in zip(asked, table.column("more").to_pylist(), strict=True):
            counters[cells] = np.minimum(counters[cells] + 1 + np.unpackbits(np.frombuffer(more, np.uint8), count=len(cells)), 2)
        return _answer_rows([(b, key[0].as_py(), key[1].as_py(), np.packbits(counters[cells] > 1).tobytes()) for b, cells in asked])

    return answer


def _candidates(window: int, bits: int, part_bits: int):
    """Pass two, asking: the windows estimated as repeated, with the block's smallest document of each."""

    def ask(key: tuple[pa.Scalar, ...], docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _question_rows([])
        block = _Block(docs, window)
        h, g, d, _ = block.distinct(block.repeated(bits, part_bits, _answers(answers)))
        name, rows = docs.column("block")[0].as_py(), []
        for p, a, b in _cuts(h >> np.uint64(64 - part_bits)):
            used, place = np.unique(d[a:b], return_inverse=True)
            rows.append((name, 2, p, h[a:b].tobytes() + g[a:b].tobytes() + place.astype(np.uint32).tobytes(), block.doc[used].tobytes()))
        return _question_rows(rows)

    return ask


def _group(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Pass two, answering: exact groups of one hash range; is there a smaller document than the block's own?"""
    asked = []
    for block, marks, more in zip(table.column("block").to_pylist(), table.column("marks").to_pylist(), table.column("more").to_pylist(), strict=True):
        n = len(marks) // 16
        place = np.frombuffer(marks, np.uint32, n, 12 * n)
        asked.append((block, np.frombuffer(marks, np.uint64, n), np.frombuffer(marks, np.uint32, n, 8 * n), np.frombuffer(more, np.int64)[place]))
    h, g, d = (np.concatenate([x[k] for x in asked]) for k in (1, 2, 3))
    order = np.lexsort((d, g, h))
    new = np.ones(len(order), bool)
    new[1:] = (h[order[1:]] != h[order[:-1]]) | (g[order[1:]] != g[order[:-1]])
    least = np.empty(len(order), np.int64)
    least[order] = d[order[new]][np.cumsum(new) - 1]
    out, at = [], 0
    for block, own, _, _ in asked:
        mine = slice(at, at + len(own))
        out.append((block, 2, key[0].as_py(), np.packbits(least[mine] < d[mine]).tobytes()))
        at += len(own)
    return _answer_rows(out)


def _covered(window: int, bits: int, part_bits: int, finish):
    """The end: the words of each document under a window with a smaller document; ``finish`` makes the rows."""

    def end(key: tuple[pa.Scalar, ...], docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return finish([], [], [])
        block, got = _Block(docs, window), _answers(answers)
        which = block.repeated(bits, part_bits, got)
        h, _, d, place = block.distinct(which)
        elsewhere = _flags(h >> np.uint64(64 - part_bits), 2, got)[place]
        doc = block.doc[block.owner[block.at[which]]]
        hit = block.at[which[elsewhere | (doc > block.doc[d][place])]]
        edge = np.zeros(len(block.owner) + 1, np.int64)
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + window, -1)
        under = np.cumsum(edge)[:-1] > 0
        ends = np.cumsum(block.lengths)
        return finish(block.doc, block.words, [under[e - n:e] for e, n in zip(ends, block.lengths, strict=True)], block.data)

    return end


def _digest(doc, words, under, data=()) -> pa.Table:
    kept = [[w for w, gone in zip(x, u, strict=True) if not gone] if u.any() else x for x, u in zip(words, under, strict=True)]
    return pa.table([core.id_array(np.asarray(doc, np.int64)), pa.array([len(x) for x in words], pa.int64()), pa.array([int(u.sum()) for u in under], pa.int64()),
                     pa.array([hashlib.sha256(b" ".join(x)).hexdigest() for x in kept], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def _spans(doc, words, under, data=()) -> pa.Table:
    """Documents that lose words, with what is left of their text: white space between kept words stays."""
    at = [k for k, u in enumerate(under) if u.any()]
    out = []
    for k in at:
        text, pos, kept = data[k], 0, []
        for word, gone in zip(words[k], under[k], strict=True):
            found = text.index(word, pos)
            if not gone:
                kept.append(text[pos:found] + word)
            pos = found + len(word)
        out.append(b"".join(kept).strip().decode())
    return pa.table([core.id_array(np.asarray([doc[k] for k in at], np.int64)), pa.array([hashlib.sha256(data[k]).hexdigest() for k in at], pa.string()),
                     pa.array(out, pa.string())], names=["doc_id", "sha256", "text"])


def _run(docs: DataFrame, window: int, finish, schema: str, id_col: str, text_col: str) -> DataFrame:
    spark, size = docs.sparkSession, core.input_bytes(docs, text_col)
    blocks = core.parts(spark, size, BLOCK_BYTES)
    part_bits = max(1, int(np.ceil(np.log2(core.parts(spark, size, RANGE_BYTES)))))
    bits = max(part_bits + 8, int(np.ceil(np.log2(max(size, 1)))))  # a window has about six bytes of text, so about six cells
    rows = core.texts(docs, id_col, text_col).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks))).select("block", "doc_id", "data")
    rows = rows.repartition(core.parts(spark, size, 2 * BLOCK_BYTES), "block")  # dealt out once, used by three steps
    sketch = rows.groupBy("block").applyInArrow(_sketch(window, bits, part_bits), _QUESTION)
    first = sketch.groupBy("step", "part").applyInArrow(_merge(1 << (bits - part_bits)), _ANSWER)
    first = first.repartition(core.parts(spark, size, 2 * BLOCK_BYTES), "block")
    asked = rows.groupBy("block").cogroup(first.groupBy("block")).applyInArrow(_candidates(window, bits, part_bits), _QUESTION)
    second = asked.groupBy("part").applyInArrow(_group, _ANSWER)
    answers = first.unionByName(second)
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_covered(window, bits, part_bits, finish), schema)


def removed_words(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: words, words removed, and the hash of what is kept."""
    return _run(docs, window, _digest, "doc_id long, n_words long, n_removed long, kept_sha256 string", id_col, text_col)


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """All documents with their columns, without the words that an earlier document has in a whole window."""
    left = _run(docs, window, _spans, "doc_id long, sha256 string, text string", "doc_id", "text")
    left = left.groupBy("doc_id", "sha256").agg(F.first("text").alias("_left")).withColumnsRenamed({"doc_id": "_left_id", "sha256": "_left_sha"})
    on = docs["doc_id"].eqNullSafe(left["_left_id"]) & (F.sha2(docs["text"].cast("binary"), 256) == left["_left_sha"])
    out = docs.join(left, on, "left").withColumn("text", F.coalesce("_left", "text")).select(*[f"`{c}`" for c in docs.columns])
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i+49], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
hits AS (SELECT doc_id, i FROM windows QUALIFY min(doc_id) OVER (PARTITION BY g) < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS pos FROM hits, range(50) r(k)),
words AS (SELECT doc_id, w[pos] AS word, pos FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS pos FROM d)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""


@query("op4_substring_dedup", SQL)
def op4(spark, sf_dir):
    return removed_words(core.read(spark, sf_dir, "documents"))
