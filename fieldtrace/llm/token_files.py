"""Token-ID output: documents' ids in binary shards, each compressed alone with one shared zstandard dictionary.

Method: a dictionary is trained on the serialised id arrays of a stated number of documents and stored under its
SHA-256. Shards hold documents in ascending doc_id order (ranges of ids, one shard per task): a header with the
dictionary's hash, one frame per document, and an index of doc_ids, frame offsets and token counts at the end. A
short document is read by two range reads, the index and its frame.

Whole texts are encoded by the tokenizers library. A byte-level tokenizer never joins the text before a space and a
space followed by a non-space, so a text is cut there and recurring units come from a bounded memory of the worker.

Defined cases: null or empty text is the end id alone; null doc_ids come last; rows that repeat a doc_id are each
written, in order of their text; an empty table gives no shard.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldtrace.llm import core, files
from fieldtrace.llm.registry import query

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END = 2  # id behind each document
REMEMBERED = 1_200_000  # units that a worker remembers
TRAINING_DOCS = 1000  # documents whose ids train the dictionary
DICTIONARY_BYTES = 64 << 10
SHARD_BYTES = 16 << 20  # text of a shard
LEVEL = 3
MAGIC = b"ZTOKENS1"
_ODD = re.compile(r" (?=\s|\Z)")
_SPACED = re.compile(r"\s")
_CUTS = re.compile(r"(?= \S)")


class Encoder:
    """Whole texts to little-endian 32-bit ids, by the units that the tokenizer itself never joins."""

    def __init__(self, path: str = TOKENIZER):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._tokenizer.model._resize_cache(0)  # what it meets here has not been met before
        words = self._tokenizer.get_vocab()
        self._spaced = np.zeros(max(words.values()) + 1, bool)
        self._spaced[[i for w, i in words.items() if w.startswith("Ġ")]] = True  # the vocabulary's letter for a space
        self._line = self._tokenizer.encode("\n", add_special_tokens=False).ids[0]
        self._known: dict[str, bytes] = {}  # ids of a unit behind a space

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, units: list[str]) -> list[bytes]:
        """Ids of units without white space, each behind a space: encoded as long texts, cut before ids that begin with one."""
        texts = [" " + " ".join(units[k:k + 2000]) for k in range(0, len(units), 2000)]
        ids = np.concatenate([np.array(x.ids, "<u4") for x in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)] or [np.zeros(0, "<u4")])
        cuts = (4 * np.append(np.flatnonzero(self._spaced[ids]), len(ids))).tolist()
        if len(cuts) != len(units) + 1:
            raise ValueError("the tokenizer joins text across a space")
        data = ids.tobytes()
        return [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _heads(self, units: list[str]) -> list[bytes]:
        """Ids of first units: those without white space as lines of one text, as a lone line feed is an id of its own."""
        plain = list({u for u in units if u and not _SPACED.search(u)})
        known = {}
        if plain:
            ids = np.array(self._tokenizer.encode_batch_fast(["\n".join(plain)], add_special_tokens=False)[0].ids, "<u4")
            lines = np.flatnonzero(ids == self._line)
            if len(lines) != len(plain) - 1:
                raise ValueError("the tokenizer joins text across a line feed")
            data = ids.tobytes()
            known = dict(zip(plain, (data[4 * a:4 * b] for a, b in zip([0, *(lines + 1).tolist()], [*lines.tolist(), len(ids)], strict=True)), strict=True))
        rest = list({u for u in units if u not in known})
        known.update(zip(rest, self._ids(rest), strict=True))
        return [known[u] for u in units]

    def _learn(self, units: list[str]) -> None:
        known = self._known
        new = [u for u in units if u not in known]
        if len(known) + len(new) > REMEMBERED:  # units that recur stay
            self._known = known = {u: known[u] for u in units if u in known}
        plain = [u for u in new if u.isalpha() or u and not _SPACED.search(u)]
        known.update(zip(plain, self._joined(plain), strict=True))
        rest = [u for u in new if u not in known]
        known.update(zip(rest, self._ids([" " + u for u in rest]), strict=True))

    def _cut(self, lists: pa.ListArray) -> list[bytes]:
        """Ids of texts given as their units; each distinct unit is looked up once, the first of a text has no space."""
        heads = self._heads(pc.list_element(lists, 0).to_pylist())
        ends = np.asarray(lists.offsets)
        units = lists.flatten().dictionary_encode()
        distinct, index = units.dictionary.to_pylist(), np.asarray(units.indices)
        self._learn(distinct)
        parts = [self._known[u] for u in distinct]
        size = np.array([len(x) // 4 for x in parts], np.int64)
        begin, count = np.cumsum(size) - size, size[index]
        count[ends[:-1]] = 0
        upto = np.cumsum(count)
        ids = np.frombuffer(b"".join(parts), "<u4")[np.repeat(begin[index] - upto + count, count) + np.arange(upto[-1] if len(upto) else 0)].tobytes()
        cuts = (4 * np.append(0, upto)[ends]).tolist()
        return [head + ids[a:b] for head, a, b in zip(heads, cuts[:-1], cuts[1:], strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        out: dict[int, bytes] = {}
        special = {k for k, t in enumerate(texts) if any(s in t for s in self._special)}  # added tokens are found before anything is cut
        odd = {k for k, t in enumerate(texts) if k not in special and _ODD.search(t)}
        plain = [k for k in range(len(texts)) if k not in special and k not in odd]
        out.update(zip(special, self._ids([texts[k] for k in special]), strict=True))
        if odd:
            cut = [_CUTS.split(texts[k]) for k in odd]
            out.update(zip(odd, self._cut(pa.array([[x[0], *(u[1:] for u in x[1:])] for x in cut], pa.list_(pa.string()))), strict=True))
        if plain:
            out.update(zip(plain, self._cut(pc.split_pattern(pa.array([texts[k] for k in plain], pa.string()), " ")), strict=True))
        return [out[k] for k in range(len(texts))]


_ENCODERS: dict[str, Encoder] = {}  # per worker


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def serialise(ids: bytes, width: int) -> bytes:
    """Ids as little-endian integers of 2 or 4 bytes."""
    return ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def restore(data: bytes, width: int) -> bytes:
    return data if width == 4 else np.frombuffer(data, "<u2").astype("<u4").tobytes()


def train(samples: list[bytes]) -> bytes:
    """A zstandard dictionary; where there is too little to train on, the samples' own bytes serve as one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES] or b"\0" * 8


def _sample(path: str, width: int):
    def run(batches):
        for batch in core.slices(batches):
            ids = _encoder(path).encode([x.decode("utf-8", "replace") for x in core.blobs(batch)])
            yield pa.RecordBatch.from_arrays([pa.array([serialise(x, width) for x in ids], pa.binary())], names=["ids"])

    return run


class ShardWriter:
    """Frames of documents in the order given, then the index and the footer."""

    def __init__(self, dictionary: bytes, width: int):
        self._hash = hashlib.sha256(dictionary).digest()
        self._compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary))
        self._width, self._frames, self._docs, self._counts = width, [], [], []

    def add(self, doc_id: int, ids: bytes) -> None:
        self._docs.append(doc_id)
        self._counts.append(len(ids) // 4)
        self._frames.append(self._compressor.compress(serialise(ids, self._width)))

    @property
    def tokens(self) -> int:
        return sum(self._counts)

    def write(self, out) -> None:
        head = MAGIC + self._hash + bytes([self._width])
        ends = len(head) + np.cumsum([0, *map(len, self._frames)])
        out.write(head)
        for frame in self._frames:
            out.write(frame)
        out.write(np.array([self._docs, ends[:-1], self._counts], "<i8").tobytes())
        out.write(np.array([len(self._docs), ends[-1]], "<i8").tobytes() + MAGIC)


class ShardReader:
    """Documents of a shard by range reads: footer and index once, then any document's frame."""

    def __init__(self, uri: str):
        self._file = files.Ranges(uri)
        head = self._file.read(0, 41)
        tail = self._file.read(self._file.size - 24, 24)
        if head[:8] != MAGIC or tail[16:] != MAGIC:
            raise ValueError(f"{uri} is no token shard")
        n, self._end = np.frombuffer(tail[:16], "<i8").tolist()
        self.width = head[40]
        self.docs, self._offsets, self.counts = np.frombuffer(self._file.read(self._end, 24 * n), "<i8").reshape(3, n)
        with files.Ranges(f"{uri.rpartition('/')[0]}/{head[8:40].hex()}.zdict") as f:
            dictionary = f.read(0, f.size)
        if hashlib.sha256(dictionary).digest() != head[8:40]:
            raise ValueError(f"the dictionary of {uri} is not the one that it was written with")
        self._decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))

    def span(self, a: int, b: int) -> list[bytes]:
        """Ids of documents a to b - 1, from one range read."""
        ends = np.append(self._offsets, self._end)[a:b + 1].tolist()
        data = self._file.read(ends[0], ends[-1] - ends[0])
        return [restore(self._decompressor.decompress(data[x - ends[0]:y - ends[0]]), self.width) for x, y in zip(ends[:-1], ends[1:], strict=True)]

    def document(self, doc_id: int) -> bytes:
        at = np.flatnonzero(self.docs == doc_id)
        if not len(at):
            raise KeyError(doc_id)
        return self.span(int(at[0]), int(at[0]) + 1)[0]

    def close(self) -> None:
        self._file.__exit__()


_MANIFEST = "shard int, uri string, n_docs long, n_tokens long"


def _write(path: str, folder: str, dictionary: bytes, width: int):
    def run(batches):
        from pyspark import TaskContext

        shard, writer = TaskContext.get().partitionId(), ShardWriter(dictionary, width)
        for batch in core.slices(batches, most=4 << 20):
            ids = _encoder(path).encode([x.decode("utf-8", "replace") for x in core.blobs(batch)])
            for doc, own in zip(core.ids(batch).tolist(), ids, strict=True):
                writer.add(doc, own + END.to_bytes(4, "little"))
        if writer._docs:
            uri = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.ztok"
            files.publish(uri, writer.write)
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([uri]), pa.array([len(writer._docs)], pa.int64()), pa.array([writer.tokens], pa.int64())],
                                             names=["shard", "uri", "n_docs", "n_tokens"])

    return run


def write(docs: DataFrame, path: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all documents; returns the manifest (shard, uri, n_docs, n_tokens, start), a row per shard."""
    spark = docs.sparkSession
    rows, folder = core.texts(docs, id_col, text_col), files.new_folder(spark, "tokens")
    width = 2  # ids of up to 65,536 entries
    if _encoder(path)._tokenizer.get_vocab_size() > 1 << 16:
        width = 4
    some = max(1, docs.count() // TRAINING_DOCS)
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(some)) == 0).limit(TRAINING_DOCS).mapInArrow(_sample(path, width), "ids binary")
    dictionary = train([bytes(r["ids"]) for r in sample.toLocalIterator()])
    files.publish(f"{folder}/{hashlib.sha256(dictionary).hexdigest()}.zdict", lambda out: out.write(dictionary))
    ordered = rows.repartitionByRange(core.parts(spark, core.input_bytes(docs, text_col), SHARD_BYTES), F.col("doc_id").asc_nulls_last())
    shards = core.cut(ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "data").mapInArrow(_write(path, folder, dictionary, width), _MANIFEST))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard, not per document
    return shards.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _read(batches):
    for batch in batches:
        for uri, start in zip(batch.column("uri").to_pylist(), batch.column("start").to_pylist(), strict=True):
            reader = ShardReader(uri)
            for a in range(0, len(reader.docs), 500):
                b = min(a + 500, len(reader.docs))
                ids = reader.span(a, b)
                n = np.array([len(x) // 4 for x in ids], np.int64)
                yield pa.RecordBatch.from_arrays([core.id_array(reader.docs[a:b].astype(np.int64)), pa.array(start + np.cumsum(n) - n), pa.array(n),
                                                  pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])
                start += int(n.sum())
            reader.close()


def read(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of all documents in all shards of a manifest."""
    spread = manifest.select("shard", "uri", "start").repartition(core.parts(manifest.sparkSession, 0, 1), "shard")
    return spread.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


@query("op3_token_files")
def op3(spark, sf_dir):
    return read(write(core.read(spark, sf_dir, "documents"))).drop("ids")
