"""Benchmark decontamination: item-sized windows of a text whose SimHash is near an item's, confirmed exactly.

Method: an item and each window of its number of words get a 64-bit SimHash over their weighted 5-word shingles (a
shingle weighs less the more items of the whole benchmark share it; one that no item has weighs as much as the average of
those of its window that some item has). The item fingerprints lie in four tables, one per 16-bit block, each
under all values within 4 bits of its block: of two fingerprints at most 19 bits apart, one block differs in at most
4 bits, so every fingerprint within the radius is found. Candidates are verified by exact weighted Jaccard
similarity of their shingle multisets, at 0.8 or more; there a shingle that the item does not have weighs as much as the
average of the item's own, so a changed word costs the same whether the item stands once or often in the benchmark.

A window that shares no shingle with any item has similarity 0, so fingerprints are made only for windows that hold
at least one; this loses nothing and leaves clean text at the price of one set lookup per word. Items go to the
tasks in blocks of a stated number; documents are neither shuffled nor collected.

Words: A-Z lower-cased, ASCII punctuation is white space. Defined cases: null or empty texts match nothing; items of
under five words are too short to identify a text and are skipped; a text shorter than an item is one window; equal
items are each reported; repeated rows are each reported under their doc_id (null included); in ``clean``, rows that
share a doc_id are one document and go if one of them holds an item.
"""

from __future__ import annotations

import itertools
import string
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtrace.llm import core
from fieldtrace.llm.registry import query

K = 5
SIMILARITY = 0.8
RADIUS, BLOCKS, BLOCK_BITS = 19, 4, 16
NEAR = RADIUS // BLOCKS  # one of the blocks is at most this far away
ITEMS = 1000  # items that one task holds at a time; their tables take about 40 MB
SCALE = 60  # weight of a shingle that one item has

_TABLE = bytes.maketrans(string.ascii_uppercase.encode() + string.punctuation.encode(), string.ascii_lowercase.encode() + b" " * len(string.punctuation))


def words(data: bytes) -> list[bytes]:
    return data.translate(_TABLE).split()


def _masks() -> np.ndarray:
    """All 16-bit numbers with at most NEAR bits set."""
    n = np.arange(1 << BLOCK_BITS, dtype=np.uint16)
    return n[np.bitwise_count(n) <= NEAR]


def signs(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Rows of +weight or -weight by the 64 bits of each hash."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32)
    return (2 * bits - 1) * weights[:, None].astype(np.int32)


def fingerprint(sums: np.ndarray) -> np.ndarray:
    """64-bit SimHash of rows of summed signs."""
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8").ravel()


def weighted_jaccard(a: dict, b: dict, weight) -> float:
    shared = sum(min(n, b[s]) * weight(s) for s, n in a.items() if s in b)
    return shared / (sum(n * weight(s) for s, n in a.items()) + sum(n * weight(s) for s, n in b.items()) - shared)


class Index:
    """Items of one block: shingle weights and, per item length, four block tables over all near values.

    An item is (id, text), or (id, text, its shingles that other items have too, with the number of items) where the
    benchmark has further items than these.
    """

    def __init__(self, items: list[tuple]):
        rows = [(i, core.rolling(core.hash_words(w), K), len(w)) for i, w in ((x[0], words(x[1])) for x in items) if len(w) >= K]
        self.ids = [r[0] for r in rows]
        self.shingles = [Counter(r[1].tolist()) for r in rows]
        spread = Counter(s for c in self.shingles for s in c)
        for x in items:
            spread.update({s: n - spread[s] for s, n in x[2]} if len(x) > 2 else {})
        self.weights = {s: max(1, round(SCALE / n)) for s, n in spread.items()}
        self.averages = [sum(n * self.weights[s] for s, n in c.items()) / c.total() for c in self.shingles]
        self.known = np.array(sorted(spread), np.uint64)
        self.known_weights = np.array([self.weights[s] for s in self.known.tolist()], np.int32)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.known & np.uint64((1 << 20) - 1)] = True
        self.prints = np.array([fingerprint(signs(r[1], self.weigh(r[1])).sum(0, keepdims=True))[0] for r in rows], np.uint64)
        lengths = np.array([r[2] for r in rows], np.int64)
        self.tables = {int(n): self._tables(np.flatnonzero(lengths == n)) for n in np.unique(lengths)}

    def _tables(self, which: np.ndarray):
        masks, out = _masks(), []
        for block in range(BLOCKS):
            part = (self.prints[which] >> np.uint64(BLOCK_BITS * block)).astype(np.uint16)
            near = (part[:, None] ^ masks[None, :]).ravel()
            order = np.argsort(near, kind="stable")
            out.append((np.searchsorted(near[order], np.arange((1 << BLOCK_BITS) + 1)), np.repeat(which, len(masks))[order].astype(np.int32)))
        return out

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        """Positions of shingles that some item has."""
        at = np.flatnonzero(self.maybe[hashes & np.uint64((1 << 20) - 1)])
        place = np.minimum(np.searchsorted(self.known, hashes[at]), len(self.known) - 1)
        return at[self.known[place] == hashes[at]] if len(self.known) else at[:0]

    def weigh(self, hashes: np.ndarray) -> np.ndarray:
        """Weights of shingles, 0 where no item has it."""
        if not len(self.known):
            return np.zeros(len(hashes), np.int32)
        place = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[place] == hashes, self.known_weights[place], 0).astype(np.int32)

    def similarity(self, item: int, window: Counter) -> float:
        """Weighted Jaccard of an item and a window; a shingle that the item does not have weighs as its average one."""
        own, average = self.shingles[item], self.averages[item]
        return weighted_jaccard(own, window, lambda s: self.weights[s] if s in own else average)

    def near(self, length: int, prints: np.ndarray):
        """(window, item, distance) of all pairs within the radius, by the block tables of one item length."""
        seen = []
        for block, (starts, items) in enumerate(self.tables[length]):
            part = ((prints >> np.uint64(BLOCK_BITS * block)) & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int64)
            n = starts[part + 1] - starts[part]
            window = np.repeat(np.arange(len(prints)), n)
            at = np.repeat(starts[part], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            seen.append(window * len(self.ids) + items[at])
        pair = np.unique(np.concatenate(seen))
        window, item = pair // len(self.ids), pair % len(self.ids)
        distance = np.bitwise_count(prints[window] ^ self.prints[item])
        good = distance <= RADIUS
        return window[good], item[good], distance[good]

    def search(self, hashes: np.ndarray, n_words: int):
        """Best verified window of each item in one text: (item, first word, words, distance, similarity)."""
        hits = self.hits(hashes)
        if not len(hits):
            return []
        best: dict[int, tuple] = {}
        # stretches of text around the hits: a prefix of summed signs gives any window's fingerprint by one difference
        longest = max(self.tables)
        cuts = np.flatnonzero(np.diff(hits) > 2 * longest) + 1
        for group in np.split(hits, cuts):
            lo, hi = max(0, int(group[0]) - longest), min(len(hashes), int(group[-1]) + longest)
            own = hashes[lo:hi]
            weights = self.weigh(own)
            sums, new = np.zeros((len(own) + 1, 64), np.int64), np.zeros((len(own) + 1, 64), np.int64)
            np.cumsum(signs(own, weights), axis=0, out=sums[1:])
            np.cumsum(signs(own, weights == 0), axis=0, out=new[1:])
            held, heavy = np.concatenate([[0], np.cumsum(weights > 0)]), np.concatenate([[0], np.cumsum(weights, dtype=np.int64)])
            for length in self.tables:
                size = min(length, n_words) - K + 1  # shingles of the window
                starts = np.arange(max(0, len(own) - size + 1))
                starts = starts[held[starts + size] > held[starts]]
                if not len(starts):
                    continue
                ends = starts + size
                # known shingles by their weights, the others by the average of these, times the number of known ones
                both = (sums[ends] - sums[starts]) * (held[ends] - held[starts])[:, None] + (new[ends] - new[starts]) * (heavy[ends] - heavy[starts])[:, None]
                window, item, distance = self.near(length, fingerprint(both))
                for w, i, d in zip(starts[window].tolist(), item.tolist(), distance.tolist(), strict=True):
                    got = self.similarity(i, Counter(own[w:w + size].tolist()))
                    if got >= SIMILARITY and (i not in best or (got, -w) > (best[i][4], -best[i][1])):
                        best[i] = (self.ids[i], lo + w, size + K - 1, d, got)
        return [best[i] for i in sorted(best)]


_BUILT: dict = {}  # per worker: the index of the last block of items


def _index(items) -> Index:
    key = hash(items)
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Index(list(items))
    return _BUILT[key]


def _search(items):
    def run(batches):
        index = _index(items)
        for batch in core.slices(batches):
            rows = []
            if index.ids:
                own = [words(x) for x in core.blobs(batch)]
                lengths = np.array([len(w) for w in own], np.int64)
                base, ends = core.hash_words(list(itertools.chain.from_iterable(own))), np.cumsum(lengths)
                rolled = core.rolling(base, K)
                # shingles that cross from one text into the next are no shingles; few texts hold any hit at all
                at = index.hits(rolled)
                for k in np.unique(np.searchsorted(ends, at, "right")).tolist():
                    first = int(ends[k] - lengths[k])
                    if lengths[k] >= K:
                        rows += [(batch.column("doc_id")[k].as_py(), *x) for x in index.search(rolled[first:int(ends[k]) - K + 1], int(lengths[k]))]
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)],
                                             names=["doc_id", "item_id", "first_word", "n_words", "distance", "similarity"])

    return run


def _shingles(batches):
    """The distinct shingles of each item."""
    for batch in core.slices(batches):
        own = [np.unique(core.rolling(core.hash_words(words(x)), K)).view(np.int64) for x in core.blobs(batch)]
        rows = np.repeat(np.asarray(batch.column("row"), np.int64), [len(x) for x in own])
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(np.concatenate(own), pa.int64())], names=["row", "shingle"])


def shared(benchmark: DataFrame, item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, data, others): items, and those of their shingles that further items have, with the number of items of the whole benchmark."""
    items = core.cut(benchmark.where(F.col(f"`{item_text}`").isNotNull() & F.col(f"`{item_col}`").isNotNull())
                     .select(F.monotonically_increasing_id().alias("row"), F.col(f"`{item_col}`").cast("long").alias("item_id"), F.col(f"`{item_text}`").cast("string").cast("binary").alias("data")))
    each = items.mapInArrow(_shingles, "row long, shingle long")
    often = each.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    others = each.join(often, "shingle").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("shingle", "n"))).alias("others"))
    return items.join(others, "row", "left").orderBy("row").select("item_id", "data", "others")


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, first_word, n_words, distance, similarity): the best window of each item in each document."""
    items = ((r[0], bytes(r[1]), tuple((x[0] % (1 << 64), x[1]) for x in r[2] or ())) for r in shared(benchmark, item_col, item_text).toLocalIterator())
    rows, found = core.texts(docs, id_col, text_col), None
    schema = "doc_id long, item_id long, first_word long, n_words long, distance long, similarity double"
    while (block := tuple(itertools.islice(items, ITEMS))) or found is None:
        part = rows.mapInArrow(_search(block), schema)
        found = part if found is None else found.unionByName(part)
    return found


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, with their columns."""
    bad = leaks(docs, benchmark).select(F.col("doc_id").alias("_bad_id")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_bad_id"]), "left_anti")


@query("op2_decontaminate")
def op2(spark, sf_dir):
    return leaks(core.read(spark, sf_dir, "documents"), core.read(spark, sf_dir, "benchmark"))
