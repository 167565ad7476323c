"""Phrase collocation mining over sorted count streams.

Method: windows of five words (shorter at the end of a piece) are counted once. A task sorts the windows of a slice of
text under its own small dictionary, adds equal ones up and sends each range of the window order one packed block. A
range merges its blocks in prefix order; as a phrase's windows lie side by side there, the counts of all phrases of one
to five words are sums of runs. Runs that touch the end of a range are added up across ranges; all others below the
least count go at once, and a frequent phrase has only frequent parts, so nothing more is needed.

The stream of frequent phrases is kept in prefix order and in suffix order. A scan in prefix order meets a phrase after
all its first parts, which are the open phrases of a stack: that gives the left counts, and the largest count among a
phrase's extensions by one word to the right. The scan in suffix order gives right counts and extensions to the left.
No table of phrases is hashed or held; where a range starts inside open phrases, it gets them from the range before.
A phrase lies in a longer one of the same count just when it lies in one that is a word longer.

Defined cases: null, empty or blank texts have no words; a null lang is ``und``, together with a lang of that name;
rows that repeat a doc_id each count, as does a row with a null id; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import struct
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldtrace.llm import core
from fieldtrace.llm.registry import query

LONGEST, LEAST, TOP = 5, 100, 2000
SLICE = 8 << 20  # bytes of text that a task sorts at a time
EACH = 8 << 20  # bytes of text whose windows one range takes, on average
SAMPLE, LEAST_SAMPLE = 1 / 40, 2 << 20  # share of the documents, and bytes of text at least, that tell the ranges' bounds
THIN = 37  # of the sampled text's windows, every so many-th tells a bound
FAN = 64  # ranges whose best phrases are ranked together before the last ranking
_TABLE = bytes(10 if chr(b) in ".,;:!?" or 10 <= b <= 13 else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


# --- windows

def tokens(data: list[bytes], langs: np.ndarray):
    """(word numbers from 1 in byte order, sorted dictionary, piece of each word, lang of each word)."""
    buf = np.frombuffer(b"\n".join([*data, b""]).translate(_TABLE), np.uint8)
    end = buf == 10
    word = ~(end | (buf == 32))
    step = np.diff(word.astype(np.int8), prepend=0, append=0)
    start, stop = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    offsets = np.zeros(len(start) + 1, np.int32)
    np.cumsum(stop - start, out=offsets[1:])
    coded = pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(buf[word])]).dictionary_encode()
    order = np.asarray(pc.sort_indices(coded.dictionary))
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(1, len(order) + 1)
    ends = np.cumsum([len(x) + 1 for x in data])
    return rank[np.asarray(coded.indices)], coded.dictionary.take(pa.array(order)).to_pylist(), np.cumsum(end)[start], langs[np.searchsorted(ends, start, "right")]


def windows(ids: np.ndarray, piece: np.ndarray) -> list[np.ndarray]:
    """Five columns: the word at each position and the next four of its piece, 0 where there is none."""
    out = [ids]
    for j in range(1, LONGEST):
        col = np.zeros_like(ids)
        col[:-j] = np.where(piece[j:] == piece[:-j], ids[j:], 0)
        out.append(col)
    return out


def sort_sum(cols: list[np.ndarray], count: np.ndarray):
    """(columns, counts): rows in order of the columns, equal ones added up. Columns are packed into few sort keys."""
    keys, used = [], 64
    for c in cols:
        bits = max(int(c.max(initial=0)).bit_length(), 1)
        if used + bits > 64:
            keys.append(np.zeros(len(c), np.uint64))
            used = 0
        keys[-1] = (keys[-1] << np.uint64(bits)) | c.astype(np.uint64)
        used += bits
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    del keys, k
    at = np.flatnonzero(new)
    total = np.add.reduceat(count[order], at) if len(at) else count[:0]
    order = order[at]
    return [c[order] for c in cols], total


def packed(cols: list[np.ndarray], count: np.ndarray, words: list[bytes], langs: list[bytes]) -> bytes:
    """A run of sorted windows with the words it uses. Words hold no line feed, which separates them here."""
    used, inverse = np.unique(np.concatenate([[0], *cols[1:]]), return_inverse=True)  # 0 stands first: no word
    kind = "<u2" if len(used) < 1 << 16 else "<u4"
    text = b"\n".join([words[i - 1] for i in used[1:].tolist()])
    names = b"\n".join(langs)
    body = [text, names, cols[0].astype("<u2").tobytes(), inverse[1:].astype(kind).tobytes(), count.astype("<u4").tobytes()]
    return struct.pack("<IIIB", len(count), len(text), len(names), int(kind[-1])) + zstandard.ZstdCompressor(level=1).compress(b"".join(body))


def unpacked(blob: bytes):
    """(lang numbers, five columns of word numbers, counts, words, langs) as they went into ``packed``."""
    n, text, names, width = struct.unpack_from("<IIIB", blob)
    body = zstandard.ZstdDecompressor().decompress(blob[13:])
    words, langs = body[:text].split(b"\n") if text else [], body[text:text + names].split(b"\n")
    at = text + names
    lang = np.frombuffer(body, "<u2", n, at)
    cols = np.frombuffer(body, f"<u{width}", LONGEST * n, at + 2 * n).reshape(LONGEST, n)
    return lang, cols, np.frombuffer(body, "<u4", n, at + 2 * n + width * LONGEST * n), words, langs


def _lang_codes(batch):
    """(sorted names, number of each row's lang)."""
    lang = [x.encode() for x in batch.column("lang").to_pylist()]
    names = sorted(set(lang))
    code = {x: i for i, x in enumerate(names)}
    return names, np.array([code[x] for x in lang], np.int32)


def _blocks(bounds, most: int):
    def run(batches):
        for batch in core.slices(batches, most=most):
            names, code = _lang_codes(batch)
            ids, words, piece, lang = tokens(core.blobs(batch), code)
            if not len(ids):
                continue
            cols, count = sort_sum([lang, *windows(ids, piece)], np.ones(len(ids), np.int32))
            of = lambda i: (names[cols[0][i]], tuple(words[c[i] - 1] if c[i] else b"" for c in cols[1:]))  # noqa: B023, E731
            cuts = [0, *[bisect.bisect_left(range(len(count)), b, key=of) for b in bounds.value], len(count)]
            parts = [(k, a, b) for k, (a, b) in enumerate(pairwise(cuts)) if a < b]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in parts], pa.int64()),
                                              pa.array([packed([c[a:b] for c in cols], count[a:b], words, names) for _, a, b in parts], pa.binary())], names=["part", "data"])

    return run


def _sampled(batches):
    for batch in core.slices(batches):
        names, code = _lang_codes(batch)
        ids, words, piece, lang = tokens(core.blobs(batch), code)
        at = np.arange(len(ids))[::THIN]
        cols = [c[at].tolist() for c in windows(ids, piece)] if len(ids) else []
        rows = [[words[c - 1] if c else b"" for c in row] for row in zip(*cols, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in lang[at].tolist()], pa.binary()), pa.array(rows, pa.list_(pa.binary()))], names=["lang", "words"])


def _first(batches):
    least = None
    for batch in batches:
        for row in zip(batch.column("lang").to_pylist(), map(tuple, batch.column("words").to_pylist()), strict=True):
            least = row if least is None or row < least else least
    if least:
        yield pa.RecordBatch.from_arrays([pa.array([least[0]], pa.binary()), pa.array([list(least[1])], pa.list_(pa.binary()))], names=["lang", "words"])


def bounds_of(rows: DataFrame, size: int) -> list[tuple[bytes, tuple[bytes, ...]]]:
    """First windows of the ranges, from a sample; they decide where a window is counted and no result."""
    n = core.parts(rows.sparkSession, size, EACH)
    share = max(SAMPLE, LEAST_SAMPLE / max(size, 1))
    sample = rows.sample(share, seed=12) if share < 1 else rows
    dealt = sample.mapInArrow(_sampled, "lang binary, words array<binary>").repartitionByRange(n, "lang", "words")
    return sorted({(bytes(r["lang"]), tuple(map(bytes, r["words"]))) for r in dealt.mapInArrow(_first, "lang binary, words array<binary>").collect()})[1:]  # one row per range


def _runs(least: int):
    def run(table: pa.Table) -> pa.Table:
        """Counts of all phrases of a range, whose windows lie side by side in prefix order. ``whole``: no other range has
        windows of this phrase. Level 0 is the lang itself."""
        words, langs = set(), set()
        for blob in table.column("data"):
            *_, known, names = unpacked(blob.as_py())
            words.update(known)
            langs.update(names)
        words, langs = sorted(words), sorted(langs)
        rank, code = {w: i + 1 for i, w in enumerate(words)}, {x: i for i, x in enumerate(langs)}
        cols, counts = [], []
        for blob in table.column("data"):  # one at a time: together they take more than the numbers made of them
            lang, own, count, known, names = unpacked(blob.as_py())
            to = np.zeros(len(known) + 1, np.int32)
            to[1:] = np.fromiter((rank[w] for w in known), np.int32, len(known))
            cols.append([np.array([code[x] for x in names], np.int32)[lang], *to[own]])
            counts.append(count.astype(np.int64))
        del rank
        cols, count = [np.concatenate(c) for c in zip(*cols, strict=True)], np.concatenate(counts)
        del counts
        cols, count = sort_sum(cols, count)
        out = ([], [], [], [])
        new = np.zeros(len(count), bool)
        new[0] = True
        for level in range(LONGEST + 1):
            new[1:] |= cols[level][1:] != cols[level][:-1]
            start = np.flatnonzero(new)
            f = np.add.reduceat(count, start)
            whole = np.ones(len(start), bool)
            whole[[0, -1]] = False
            kept = np.flatnonzero(((f >= least) | ~whole) & ((cols[level][start] > 0) | (level == 0)))
            at = start[kept]
            out[0].extend(langs[i] for i in cols[0][at].tolist())
            out[1].extend([words[i - 1] for i in row] for row in np.array([c[at] for c in cols[1:level + 1]]).reshape(level, len(at)).T.tolist())
            out[2].extend(f[kept].tolist())
            out[3].extend(whole[kept].tolist())
        return pa.table([pa.array(out[0], pa.binary()), pa.array(out[1], pa.list_(pa.binary())), pa.array(out[2], pa.int64()), pa.array(out[3], pa.bool_())], names=["lang", "words", "f", "whole"])

    return run


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST) -> DataFrame:
    """(lang, words, f): phrases of one to five words that occur ``least`` times; no words: all word occurrences."""
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")  # batches of long texts have to fit a worker
    rows = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary").alias("data"))
    bounds = spark.sparkContext.broadcast(bounds_of(rows, core.input_bytes(docs, text_col)))  # about 50 bytes for each 16 MB of text
    runs = core.cut(rows.mapInArrow(_blocks(bounds, SLICE), "part long, data binary").groupBy("part").applyInArrow(_runs(least), "lang binary, words array<binary>, f long, whole boolean"))
    split = runs.where("NOT whole").groupBy("lang", "words").agg(F.sum("f").alias("f")).where(F.expr(f"f >= {least} OR size(words) = 0"))
    return runs.where("whole").select("lang", "words", "f").unionByName(split).select(F.col("lang").cast("string"), F.col("words").cast("array<string>"), "f")


# --- sorted streams of frequent phrases

def in_order(counts: DataFrame, suffix: bool) -> DataFrame:
    """The stream in prefix or suffix order, in ranges, stored."""
    key = F.reverse("words") if suffix else F.col("words")
    n = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = counts.withColumn("path", key)
    return core.cut(keyed.repartitionByRange(n, "lang", "path").sortWithinPartitions("lang", "path"))


def _rows(batches):
    for batch in batches:
        yield from batch.to_pylist()


def _ends(batches):
    """Of a range: the phrases open at its end with their counts, and for open phrases of earlier ranges the largest
    count of an extension here."""
    stack, late = [], {}
    for row in _rows(batches):
        path = (row["lang"], *row["path"])
        while stack and path[:len(stack[-1][0])] != stack[-1][0]:
            stack.pop()
        if len(path) > 1 and (not stack or len(stack[-1][0]) < len(path) - 1):
            late[path[:-1]] = max(late.get(path[:-1], 0), row["f"])
        stack.append((path, row["f"]))
    out = [(p, f, True) for p, f in stack] + [(p, f, False) for p, f in late.items()]
    yield pa.RecordBatch.from_arrays([pa.array([list(p) for p, _, _ in out], pa.list_(pa.string())), pa.array([f for _, f, _ in out], pa.int64()),
                                      pa.array([o for _, _, o in out], pa.bool_())], names=["path", "f", "open"])


def _scan(seams, give):
    """Lockstep scan of a range: ``give(row, counts of all parts from none on, largest extension)`` for each phrase."""

    def run(batches):
        opened, late = seams.value
        stack, out = [], []

        def close(upto):
            while len(stack) > upto:
                path, _, row, ext = stack.pop()
                if row is not None:
                    give(out, row, [s[1] for s in stack], max(ext, late.get(path, 0)))

        for row in _rows(batches):
            path = (row["lang"], *row["path"])
            keep = len(stack)
            while keep and path[:keep] != stack[keep - 1][0]:
                keep -= 1
            close(keep)
            while len(stack) < len(path) - 1:  # opened by an earlier range
                part = path[:len(stack) + 1]
                stack.append([part, opened[part], None, 0])
            if stack:
                stack[-1][3] = max(stack[-1][3], row["f"])
            stack.append([path, row["f"], row, 0])
        close(0)
        yield from give.done(out)

    return run


class _Left:
    """Collects the stream with left counts (none first: all words of the lang) and the largest right extension."""

    SCHEMA = "lang string, words array<string>, f long, left array<long>, ext long"

    def __call__(self, out, row, parts, ext):
        if len(row["words"]) > 1:
            out.append((row["lang"], row["words"], row["f"], parts, ext))
        else:  # words and the lang itself go on, as the other order needs them open
            out.append((row["lang"], row["words"], row["f"], [], 0))

    def done(self, out):
        cols = list(zip(*out, strict=True)) if out else [[]] * 5
        kinds = (pa.string(), pa.list_(pa.string()), pa.int64(), pa.list_(pa.int64()), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["lang", "words", "f", "left", "ext"])


def scored(a: int, n: int, left: list[int], right: list[int]):
    """(score, l, r) of the lowest cut: ``left[k]``, ``right[k]`` count the first, last k words. Exact at any size."""
    size = len(left)
    return min(((1000 * a * n // (left[k] * right[size - k]), k, left[k], right[size - k]) for k in range(1, size)), key=lambda x: x[:2])


class _Scores:
    """Keeps the best phrases of each lang of a range."""

    SCHEMA = "lang string, phrase string, a long, l long, r long, n long, score long, range long"

    def __init__(self, top: int):
        self.top = top

    def __call__(self, out, row, parts, ext):
        if len(row["words"]) > 1 and max(ext, row["ext"]) < row["f"]:
            score, _, left, right = scored(row["f"], row["left"][0], row["left"], parts)
            out.append((row["lang"], " ".join(row["words"]), row["f"], left, right, row["left"][0], score))
            if len(out) > 20 * self.top:
                out[:] = self.best(out)

    def best(self, out):
        out.sort(key=lambda x: (x[0], -x[6], -x[2], x[1].encode()))
        seen, kept = {}, []
        for x in out:
            seen[x[0]] = seen.get(x[0], 0) + 1
            if seen[x[0]] <= self.top:
                kept.append(x)
        return kept

    def done(self, out):
        cols = list(zip(*self.best(out), strict=True)) if out else [[]] * 7
        kinds = (pa.string(), pa.string(), *[pa.int64()] * 5)
        part = pa.array([TaskContext.get().partitionId()] * len(cols[0]), pa.int64())
        yield pa.RecordBatch.from_arrays([*[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], part], names=["lang", "phrase", "a", "l", "r", "n", "score", "range"])


def scanned(stream: DataFrame, give) -> DataFrame:
    """``give`` over a stored stream, each range starting with the phrases that lie open there."""
    opened, late = {}, {}
    for r in stream.mapInArrow(_ends, "path array<string>, f long, open boolean").collect():  # ten short rows per range at most
        path = tuple(r["path"])
        if r["open"]:
            opened[path] = r["f"]
        else:
            late[path] = max(late.get(path, 0), r["f"])
    return stream.mapInArrow(_scan(stream.sparkSession.sparkContext.broadcast((opened, late)), give), give.SCHEMA)


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP) -> DataFrame:
    """The ``top`` phrases of each lang that occur ``least`` times and lie in no longer candidate of the same count, best first."""
    left = scanned(in_order(phrase_counts(docs, text_col, lang_col, least), suffix=False), _Left())
    best = scanned(in_order(left, suffix=True), _Scores(top))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    some = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", F.floor(F.col("range") / FAN)).orderBy(*order))).where(F.col("rank") <= top)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top).drop("range")


SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, len(q) AS size, array_to_string(q, ' ') AS phrase, count(*) AS f FROM (
  SELECT lang, w[i:i + k - 1] AS q FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w), (SELECT unnest(range(1, 6)) AS k) WHERE i + k - 1 <= len(w)) GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS q FROM g WHERE size > 1),
cuts AS (SELECT c.*, unnest(range(1, size)) AS k FROM c),
s AS (SELECT cuts.lang, cuts.phrase, a, x.f AS l, y.f AS r, n, (1000::HUGEINT * a * n // (x.f::HUGEINT * y.f)) AS score, k FROM cuts JOIN total USING (lang)
  JOIN g x ON x.lang = cuts.lang AND x.phrase = array_to_string(q[1:k], ' ') JOIN g y ON y.lang = cuts.lang AND y.phrase = array_to_string(q[k + 1:], ' ')),
low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_parts AS (SELECT lang, array_to_string(q[i:j], ' ') AS phrase, max(a) AS longer FROM c, unnest(range(1, size + 1)) t(i), unnest(range(1, size + 1)) u(j) WHERE j > i AND j - i + 1 < size GROUP BY ALL),
kept AS (SELECT low.* FROM low LEFT JOIN inner_parts USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM kept QUALIFY rank <= 2000"""


@query("op12_collocations", SQL)
def op12(spark, sf_dir):
    return collocations(core.read(spark, sf_dir, "documents"))
