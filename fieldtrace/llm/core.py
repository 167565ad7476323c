"""Shared pieces of the corpus operators: words, hashes, slices of batches, packed sorted numbers, storage.

A word is a run of bytes other than space and ``\\t \\n \\v \\f \\r``, which is what ``bytes.split()`` cuts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtrace.session import ensure_checkpoint_dir

U64 = np.uint64
_K1, _K2 = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)
NO_ID = np.iinfo(np.int64).max  # stands for a null id: larger than any other


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, data): ids and whole texts as UTF-8 bytes; a null text counts as empty.

    Batches to Python are kept small, as a batch of very long texts has to fit a worker.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary").alias("data"))


def input_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """Bytes of all texts: one scan of one column, which sizes blocks and sketches by the data themselves."""
    return docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`").cast("string"))).alias("n")).first()["n"] or 0


def slices(batches: Iterable[pa.RecordBatch], column: str = "data", most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about ``most`` bytes of ``column`` (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64))
        at = 0
        while at < batch.num_rows:
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, upto - at)
            at = upto


def blobs(batch: pa.RecordBatch, column: str = "data") -> list[bytes]:
    return [x or b"" for x in batch.column(column).to_pylist()]


def ids(batch: pa.RecordBatch, column: str = "doc_id") -> np.ndarray:
    return np.asarray(pc.fill_null(batch.column(column), NO_ID), np.int64)


def id_array(values: np.ndarray) -> pa.Array:
    """Back from ``ids``: the stand-in becomes null again."""
    return pa.array(values, pa.int64(), mask=values == NO_ID)


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), U64, len(words))


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the pair (a, b), in this order."""
    x = a * _K1
    x ^= x >> U64(31)
    x += b
    x *= _K2
    x ^= x >> U64(29)
    return x


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on, by doubling; shorter than ``h`` by k - 1."""
    n = len(h) - k + 1
    if n <= 0:
        return h[:0]
    powers = [h]
    while 2 << (len(powers) - 1) <= k:
        p, step = powers[-1], 1 << (len(powers) - 1)
        powers.append(mix(p[:-step], p[step:]))
    out, at = powers[-1][:n], 1 << (len(powers) - 1)
    for j in range(len(powers) - 2, -1, -1):
        if k >> j & 1:
            out = mix(out, powers[j][at:at + n])
            at += 1 << j
    return out


def spans(lengths: np.ndarray, k: int) -> np.ndarray:
    """Starts of all k-word windows that stay in their text, where texts of these lengths lie end to end."""
    n = int(lengths.sum())
    ends = np.repeat(np.cumsum(lengths), lengths)
    return np.flatnonzero(np.arange(n) + k <= ends)


def owners(lengths: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(lengths)), lengths)


def pack(values: np.ndarray, top: int) -> bytes:
    """Strictly increasing numbers below ``top`` in few bits each: low bytes plain, the rest as a unary bit row."""
    n = len(values)
    low = 0
    while n and top >> (8 * low) > 8 * n:
        low += 1
    head = np.array([n, low], "<u4").tobytes()
    if not n:
        return head
    v = values.astype("<u8")
    plain = v.view(np.uint8).reshape(n, 8)[:, :low].tobytes()
    bits = np.zeros(int(v[-1] >> U64(8 * low)) + n, np.uint8)
    bits[(v >> U64(8 * low)).astype(np.int64) + np.arange(n)] = 1
    return head + plain + np.packbits(bits).tobytes()


def unpack(data: bytes) -> np.ndarray:
    n, low = (int(x) for x in np.frombuffer(data, "<u4", 2))
    if not n:
        return np.zeros(0, U64)
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :low] = np.frombuffer(data, np.uint8, n * low, 8).reshape(n, low)
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, offset=8 + n * low)))[:n]
    return wide.view("<u8").ravel() + ((ones - np.arange(n)).astype(U64) << U64(8 * low))


def cut(df: DataFrame) -> DataFrame:
    """Materialised in the shared checkpoint folder, so that later steps neither recompute nor grow the plan."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def parts(spark: SparkSession, size: int, each: int, least: int | None = None) -> int:
    """Number of groups for ``size`` bytes at ``each`` bytes; at least the session's shuffle partitions."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions")) if least is None else least
    return max(least, -(-size // each), 1)
