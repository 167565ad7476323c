"""SentencePiece encoding and decoding of a BPE model, by suffix-array matching.

Method: the distinct segments of a batch (a segment is a run of spaces and what follows up to the next) are laid end
to end and a suffix array over them, as deep as the longest piece, is built. Every piece is binary-searched for its
range of occurrences. The occurrences are edges; sorted by the position where they end, they are relaxed from left to
right: an edge holds if the piece before it and its own piece stay apart when merged by priority, which is true of
exactly one edge per position, so the last edges of all prefixes give the model's own merge result.

No piece has a space behind another character, so segments are independent of each other. Characters without a piece
become byte pieces. Segments that recur are taken from a bounded memory of the worker.

Defined cases: null or empty text has no ids and decodes to the empty text; U+2581 in a text is encoded like a space,
as the model does, and so decodes as one; rows are independent, so repeated rows repeat their result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import sentencepiece
from pyspark.sql import DataFrame

from fieldtrace.llm import core
from fieldtrace.llm.registry import query

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SPACE = "▁"
REMEMBERED = 300_000  # segments that a worker remembers
_CODE = 13  # bits of a character in the packed suffixes: up to 8,190 characters with pieces of two or more
_SEGMENTS = regex.compile(r" +[^ ]*|[^ ]+")


class Model:
    """Vocabulary of a BPE model: pieces, priorities, the two parts of each piece, and which pairs join."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.id_of = {self.pieces[i]: i for i in plain}
        order = sorted((i for i in plain if len(self.pieces[i]) > 1), key=lambda i: (-sp.get_score(i), i))
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.rank = np.full(n, -1, np.int64)  # single characters are there from the start
        self.rank[order] = np.arange(len(order))
        joins = {}
        for i in order:
            p = self.pieces[i]
            for k in range(1, len(p)):
                if (a := self.id_of.get(p[:k])) is not None and (b := self.id_of.get(p[k:])) is not None:
                    joins[a * n + b] = i
        self.n, self.join_keys = n, np.array(sorted(joins), np.int64)
        self.join_ids = np.array([joins[k] for k in self.join_keys.tolist()], np.int64)
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        usable = [i for i in plain if len(self.pieces[i]) == 1]
        for i in order:
            parts = self._merged(self.pieces[i], i, joins)
            if parts:
                self.left[i], self.right[i] = parts
                usable.append(i)
        self.usable = np.array(sorted(usable), np.int64)
        self.length = np.array([len(p) for p in self.pieces], np.int64)
        self.longest = int(self.length[self.usable].max())
        alphabet = sorted({c for i in usable for c in self.pieces[i] if len(self.pieces[i]) > 1})
        if len(alphabet) + 2 >= 1 << _CODE:
            raise ValueError(f"the pieces use {len(alphabet)} characters, more than {(1 << _CODE) - 2}")
        self.alphabet = np.array([ord(c) for c in alphabet], np.uint32)
        single = sorted((ord(self.pieces[i]), i) for i in usable if len(self.pieces[i]) == 1)
        self.single_chars, self.single_ids = np.array([c for c, _ in single], np.uint32), np.array([i for _, i in single], np.int64)
        self.many = self.usable[self.length[self.usable] > 1]
        width = -(-self.longest // 4) * 4
        grid = np.zeros((len(self.many), width), np.uint64)
        for row, i in enumerate(self.many):
            grid[row, :self.length[i]] = self.codes(np.array([ord(c) for c in self.pieces[i]], np.uint32))
        self.low = _packed(grid)
        self.high = _packed(np.where(np.arange(width) < self.length[self.many][:, None], grid, np.uint64((1 << _CODE) - 1)))
        self.bytes = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]

    def _merged(self, text: str, whole: int, joins: dict):
        """The last two parts when merging ``text`` by priority; None if that does not end in the piece itself."""
        parts = [self.id_of.get(c) for c in text]
        if None in parts:
            return None
        while len(parts) > 2:
            found = [(self.rank[z], k, z) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if (z := joins.get(a * self.n + b)) is not None]
            if not found:
                return None
            _, k, z = min(found)
            parts[k:k + 2] = [z]
        return parts if len(parts) == 2 and joins.get(parts[0] * self.n + parts[1]) == whole else None

    def codes(self, chars: np.ndarray) -> np.ndarray:
        """2, 3, ... for characters of longer pieces, 1 for all others."""
        at = np.minimum(np.searchsorted(self.alphabet, chars), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == chars, at + 2, 1).astype(np.uint64)

    def joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the piece that a and b join to, or a number above all ranks."""
        key = a * self.n + b
        at = np.minimum(np.searchsorted(self.join_keys, key), len(self.join_keys) - 1)
        return np.where(self.join_keys[at] == key, self.rank[self.join_ids[at]], self.n)

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Do the pieces a and b, side by side, both come out of merging their text?

        Going back in time, the younger of the two is undone again and again; the pair at the border must never have
        had a join that came before the join that was undone (on equal priority the left join comes first).
        """
        good = np.ones(len(a), bool)
        at = np.flatnonzero((a >= 0) & (b >= 0))  # -1: a character without a piece, which joins nothing
        x, y, due = a[at], b[at], np.full(len(at), self.n)
        while len(at):
            clash = self.joined(x, y) < due
            good[at[clash]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~clash & (np.maximum(rx, ry) >= 0)
            at, x, y, rx, ry = at[go], x[go], y[go], rx[go], ry[go]
            undo = rx > ry
            due = np.where(undo, rx, ry + 1)
            x, y = np.where(undo, self.right[x], x), np.where(undo, y, self.left[y])
        return good


def _packed(grid: np.ndarray) -> np.ndarray:
    """Rows of character codes as numbers of four characters each, which compare like the characters."""
    g = grid.reshape(len(grid), -1, 4)
    out = np.zeros(g.shape[:2], np.uint64)
    for k in range(4):
        out = (out << np.uint64(_CODE)) | g[:, :, k]
    return out


def _below(suffixes: np.ndarray, keys: np.ndarray, closed: bool) -> np.ndarray:
    """Binary search for all keys at once: the number of suffixes below (or, if closed, not above) each key."""
    lo, hi = np.zeros(len(keys), np.int64), np.full(len(keys), len(suffixes), np.int64)
    while (lo < hi).any():
        mid = np.minimum((lo + hi) // 2, len(suffixes) - 1)
        less, same = np.zeros(len(keys), bool), np.ones(len(keys), bool)
        for k in range(keys.shape[1]):
            s = suffixes[mid, k]
            less |= same & (s < keys[:, k])
            same &= s == keys[:, k]
        right = (less | same if closed else less) & (lo < hi)
        lo, hi = np.where(right, mid + 1, lo), np.where(right | (lo >= hi), hi, mid)
    return lo


def edges(model: Model, chars: np.ndarray, starts: np.ndarray):
    """(start, piece) of every occurrence of a longer piece, from the suffix array of the concatenated segments.

    ``starts`` marks the first character of each segment; pieces that would run over it are not occurrences.
    """
    n = len(chars)
    code = np.zeros(n + model.longest + 4, np.uint64)
    code[:n] = model.codes(chars)
    four = np.zeros(n + model.longest, np.uint64)
    for k in range(4):
        four = (four << np.uint64(_CODE)) | code[k:k + len(four)]
    columns = [four[4 * k:4 * k + n] for k in range(model.low.shape[1])]
    order = np.lexsort(columns[::-1])
    suffixes = np.stack([c[order] for c in columns], 1)
    lo, hi = _below(suffixes, model.low, False), _below(suffixes, model.high, True)
    count = hi - lo
    piece = np.repeat(model.many, count)
    start = order[np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
    segment = np.searchsorted(starts, np.arange(n), "right")
    inside = segment[start] == segment[start + model.length[piece] - 1] if n else np.zeros(0, bool)
    return start[inside], piece[inside]


def encode(model: Model, segments: list[str]) -> list[bytes]:
    """Ids of each segment as little-endian 32-bit integers."""
    lengths = np.array([len(s) for s in segments], np.int64)
    chars = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32)
    n, ends = len(chars), np.cumsum(lengths)
    begin = ends - lengths
    starts = begin[lengths > 0]
    start, piece = edges(model, chars, starts)
    at = np.minimum(np.searchsorted(model.single_chars, chars), len(model.single_chars) - 1)
    single = np.where(model.single_chars[at] == chars, model.single_ids[at], -1)
    start, piece = np.concatenate([start, np.arange(n)]), np.concatenate([piece, single])
    size = np.where(piece < 0, 1, model.length[piece])
    first = np.repeat(begin, lengths)
    # by place in the segment: all segments take a step together; at one place long pieces come first
    place = start - first[start] + size
    order = np.lexsort((-size, place.astype(np.uint16) if n and place.max() < 1 << 16 else place))
    start, piece, size, place = start[order], piece[order], size[order], place[order]
    last, back = np.full(n + 1, -2, np.int64), np.ones(n + 1, np.int64)
    cuts = np.flatnonzero(np.diff(place, prepend=-1, append=-1))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        tries = np.flatnonzero(np.diff(size[a:b], prepend=-1, append=-1)) + a
        for c, d in zip(tries[:-1], tries[1:], strict=True):
            s, p, w = start[c:d], piece[c:d], int(size[c])
            open_ = last[s + w - 1] == -2  # kept at the last character of the prefix
            s, p = s[open_], p[open_]
            free = s == first[s]
            good = free.copy()
            rest = np.flatnonzero(~free)
            good[rest] = model.apart(last[s[rest] - 1], p[rest])
            last[s[good] + w - 1], back[s[good] + w - 1] = p[good], w
    out_piece, out_seg, out_pos = [], [], []
    seg, pos = np.flatnonzero(lengths > 0), ends[lengths > 0] - 1
    while len(seg):
        out_piece.append(last[pos])
        out_seg.append(seg)
        out_pos.append(pos)
        pos = pos - back[pos]
        go = pos >= begin[seg]
        seg, pos = seg[go], pos[go]
    if not out_piece:
        return [b""] * len(segments)
    p, where = np.concatenate(out_piece), np.concatenate(out_pos)
    order = np.argsort(where)
    p, where, seg = p[order], where[order], np.concatenate(out_seg)[order]
    bare = np.flatnonzero(p < 0)
    ids, count = p.astype(np.int64), np.ones(len(p), np.int64)
    if len(bare):
        raw = [chr(c).encode("utf-8", "surrogatepass") for c in chars[where[bare]].tolist()]
        count[bare] = [len(x) for x in raw]
        spread = np.repeat(ids, count)
        spread[np.repeat(p < 0, count)] = model.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        ids = spread
    upto = 4 * np.cumsum(np.bincount(np.repeat(seg, count), minlength=len(segments)))
    data, a, out = ids.astype("<u4").tobytes(), 0, []
    for b in upto.tolist():
        out.append(data[a:b])
        a = b
    return out


class Coder:
    """Encodes texts in batches; keeps the ids of segments that it has met, up to a bound."""

    def __init__(self, path: str = MODEL):
        self.model = Model(path)
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = []
        for text in texts:
            text = text.replace(SPACE, " ")
            # a key is a segment without its first space; the model puts one space before the text
            parts = text.split(" ") if text else []
            if "" in parts:
                parts = [x[1:] for x in _SEGMENTS.findall(" " + text)]
            cut.append(parts)
        new = list({x for parts in cut for x in parts if x not in self.known})
        if len(self.known) + len(new) > REMEMBERED:
            self.known = {x: self.known[x] for parts in cut for x in parts if x in self.known}  # what recurs stays
        self.known.update(zip(new, encode(self.model, [(" " + x).replace(" ", SPACE) for x in new]), strict=True))
        get = self.known.__getitem__
        return [b"".join(map(get, parts)) for parts in cut]

    def decode(self, ids: bytes) -> str:
        text = b"".join(map(self.model.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return text.removeprefix(b" ").decode("utf-8", "replace")


_CODERS: dict[str, Coder] = {}  # per worker


def _coder(path: str) -> Coder:
    if path not in _CODERS:
        _CODERS[path] = Coder(path)
    return _CODERS[path]


def _encode(path: str):
    def run(batches):
        coder = _coder(path)
        for batch in core.slices(batches, most=4 << 20):
            ids = coder.encode([x.decode("utf-8", "replace") for x in core.blobs(batch)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return run


def _decode(path: str):
    def run(batches):
        coder = _coder(path)
        for batch in core.slices(batches, "ids"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([coder.decode(x) for x in core.blobs(batch, "ids")], pa.string())], names=["doc_id", "text"])

    return run


def _trip(path: str, with_ids: bool):
    """Encode, decode the ids again and hold the text against the first one."""

    def run(batches):
        coder = _coder(path)
        for batch in core.slices(batches, most=4 << 20):
            texts = [x.decode("utf-8", "replace") for x in core.blobs(batch)]
            ids = coder.encode(texts)
            columns = [batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                       pa.array([coder.decode(x) == t for x, t in zip(ids, texts, strict=True)], pa.bool_())]
            if with_ids:
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
                columns.append(pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(ids), "<i4"))))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_ids", "ids_crc32", "exact", "ids"][:len(columns)])

    return run


def encoded(docs: DataFrame, path: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): whole texts as little-endian 32-bit ids."""
    return core.texts(docs, id_col, text_col).mapInArrow(_encode(path), "doc_id long, ids binary")


def decoded(rows: DataFrame, path: str = MODEL) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""
    return rows.select("doc_id", "ids").mapInArrow(_decode(path), "doc_id long, text string")


def round_trip(docs: DataFrame, path: str = MODEL, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: number and crc32 of the ids, whether decoding them gives the text, and on demand the ids."""
    return core.texts(docs, id_col, text_col).mapInArrow(_trip(path, with_ids), "doc_id long, n_ids long, ids_crc32 long, exact boolean" + ", ids array<int>" * with_ids)


@query("op8_sentence_pieces")
def op8(spark, sf_dir):
    return round_trip(core.read(spark, sf_dir, "documents"))
