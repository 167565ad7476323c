"""Quality rules: lines that many documents of a host share are removed, depleted documents are rejected.

Method: normalised lines (A-Z lower-cased, white space collapsed) are hashed; per host the distinct documents of
each hash are counted; lines above the host's limit go, and a document that loses almost all of its words is
rejected. Copies of one document must not turn its own lines into boilerplate, so they count as one document:

* Rows of a host with the same set of lines are one document.
* A document that shares no line with another counts by itself. So does one with a line of its own: six words or more,
  and none of the four smallest hashes of its three words in a row in any other line of documents with shared lines. An
  edited copy of a line keeps most of its hashes and so is not a line of its own; neither is a byline that differs in a
  number.
* Documents without such a line, which are near copies or made of shared lines alone, count once for the rarest of the
  lines that they share with others.

Defined cases: null or empty text has no words and fails the base rule; a null host is a host of its own; rows
repeated in full count once and keep their own result row; rows that share a doc_id (null included) are judged each by
its own text, and in ``clean`` they are one document and stay if one of them is kept.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtrace.llm import core
from fieldtrace.llm.registry import query

SYMBOLS = b"#*$%&|<>"
MIN_DOCS = 5  # a line in so many distinct documents of a host, or fewer, is not boilerplate
SHARE = 0.05  # nor one in up to this share of them
OWN_WORDS = 6  # a shorter line says nothing on what is a copy
LEFT_WORDS, LEFT_SHARE = 10, 0.25  # a document with less left is depleted

_FACTS = ("doc_id long, host string, row_key long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "lines array<long>, line_words array<int>, sketches array<array<long>>, line_set long")
# multipliers of three words in a row in each of the four orders of a line's sketch
_ORDERS = np.array([[998244353 ** (3 * j + i + 1) % (1 << 60) | 1 for i in range(3)] for j in range(4)], np.uint64)


def _class_table(members: bytes) -> np.ndarray:
    table = np.zeros(256, np.int64)
    table[list(members)] = 1
    return table


_SYMBOL = _class_table(SYMBOLS)
_LETTER = np.array([0 if b in b" \t\n\v\f\r" or b & 0xC0 == 0x80 else 1 for b in range(256)])  # first byte of a code point in a word


def _number(data: bytes) -> int:
    """64 bits of a digest, which SQL can compute as well."""
    return int.from_bytes(hashlib.md5(data).digest()[8:], "little")


def line_hash(line: bytes) -> int:
    """Of the line without case of A-Z and with single spaces; the same for lines that look alike."""
    return _number(b" ".join(line.lower().split())) >> 1


def sketches(lengths: np.ndarray, numbers: np.ndarray) -> list[list[int]]:
    """Of each line of ``OWN_WORDS`` words or more the smallest hash of three words in a row in each order; lines end to end."""
    own = np.flatnonzero(lengths >= OWN_WORDS)
    out: list[list[int]] = [[] for _ in lengths]
    if not len(own):
        return out
    begin = (np.cumsum(lengths) - lengths)[own]
    edges = np.stack([begin, begin + lengths[own] - 2], 1).ravel()
    least = []
    for a, b, c in _ORDERS:
        three = np.append(numbers[:-2] * a + numbers[1:-1] * b + numbers[2:] * c, core.NO_ID)
        least.append(np.minimum.reduceat(three, edges)[::2].view(np.int64))
    for k, row in zip(own.tolist(), np.stack(least, 1).tolist(), strict=True):
        out[k] = row
    return out


def repeated_words(lengths: np.ndarray, hashes: np.ndarray, k: int = 5) -> np.ndarray:
    """Per text, the words that lie in k-word windows found twice or more in it."""
    at = core.spans(lengths, k)
    owner = core.owners(lengths)
    if not len(at):
        return np.zeros(len(lengths), np.int64)
    key = core.mix(owner[at].astype(np.uint64), core.rolling(hashes, k)[at])
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + k, -1)
    return np.bincount(owner, np.cumsum(edge)[:-1] > 0, len(lengths)).astype(np.int64)


def _facts(batches):
    known: dict[bytes, int] = {}

    def number(word: bytes) -> int:
        if word not in known:
            if len(known) > 200_000:
                known.clear()
            known[word] = _number(word)
        return known[word]

    for batch in core.slices(batches):
        data = core.blobs(batch)
        words = [x.split() for x in data]
        lengths = np.array([len(x) for x in words], np.int64)
        hashes = core.hash_words([w for x in words for w in x])
        sizes = np.cumsum([0, *map(len, data)])
        raw = np.frombuffer(b"".join(data), np.uint8)
        count = lambda table: np.diff(np.concatenate([[0], np.cumsum(table[raw])])[sizes])
        dup, lines, n_line, own_words = [], [], [], []
        for x in data:
            seen: set[bytes] = set()
            found: dict[int, int] = {}
            again = 0
            for line in x.split(b"\n"):
                n = len(line.split())
                if not n:
                    continue
                again += line in seen
                seen.add(line)
                own = line.lower().split()
                h = _number(b" ".join(own)) >> 1
                if h not in found:
                    own_words.append(own)
                found[h] = found.get(h, 0) + n
            dup.append(again)
            lines.append(list(found))
            n_line.append(list(found.values()))
        ends = np.cumsum([0, *map(len, lines)])
        marks = sketches(np.array([len(x) for x in own_words], np.int64), np.fromiter((number(w) for x in own_words for w in x), np.uint64))
        sets = [xxhash.xxh3_64_intdigest(np.array(sorted(x), "<i8").tobytes()) >> 1 for x in lines]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("host"), batch.column("row_key"), pa.array(lengths), pa.array(count(_LETTER), pa.int64()), pa.array(count(_SYMBOL), pa.int64()),
             pa.array(dup, pa.int64()), pa.array(repeated_words(lengths, hashes)),
             pa.array(lines, pa.list_(pa.int64())), pa.array(n_line, pa.list_(pa.int32())), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(marks, pa.list_(pa.int64()))),
             pa.array(sets, pa.int64())],
            names=["doc_id", "host", "row_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines", "line_words", "sketches", "line_set"])


def _row_key(text_col: str) -> F.Column:
    return F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))


def line_facts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Per document the base counts, its distinct line hashes with their words and sketches, and the hash of their set."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{host_col}`").cast("string"), F.lit("")).alias("host"), _row_key(text_col).alias("row_key"),
                       F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary").alias("data"))
    return rows.mapInArrow(_facts, _FACTS)


def distinct_documents(facts: DataFrame, sets: DataFrame, shared: DataFrame) -> DataFrame:
    """(host, line_set, document): what each set of lines counts as.

    ``sets``: (host, line_set); ``shared``: (host, line_set, line, n) of the lines in n >= 2 sets. A set without shared lines
    counts for itself and takes no part in the comparison of marks.
    """
    set_key = F.xxhash64("host", "line_set")
    rarest = shared.groupBy("host", "line_set").agg(F.min(F.struct("n", "line")).alias("least")).select("host", "line_set", F.col("least.line").alias("rarest"))
    asked = facts.select("host", "line_set", "sketches").join(rarest.select("host", "line_set"), ["host", "line_set"]).groupBy("host", "line_set").agg(F.first("sketches").alias("sketches"))
    marks = asked.select("host", set_key.alias("doc"), F.posexplode("sketches").alias("at", "own")).select(F.explode("own").alias("mark"), "host", "doc", "at").select(F.xxhash64("host", "mark").alias("mark"), "doc", "at")
    # a mark that stands once comes out of the aggregate with its line
    single = marks.groupBy("mark").agg(F.count("*").alias("c"), F.first("doc").alias("doc"), F.first("at").alias("at")).where("c = 1").select("doc", "at")
    novel = single.groupBy("doc", "at").agg(F.count("*").alias("c")).where(F.col("c") == len(_ORDERS)).select("doc").distinct().withColumn("novel", F.lit(True))
    known = rarest.withColumn("doc", set_key).join(novel, "doc", "left").where("novel IS NULL").select("host", "line_set", "rarest")
    return sets.join(known, ["host", "line_set"], "left").select("host", "line_set", F.struct(F.col("rarest").isNull().alias("own"), F.coalesce("rarest", "line_set").alias("key")).alias("document"))


def common_lines(facts: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE) -> DataFrame:
    """(host, line, n_docs, bound): the lines above their host's limit, which is a share of its distinct documents.

    Lines and documents are made distinct on (host, line, document) first, so that no task meets all documents of a hot line.
    """
    sets = facts.where(F.size("lines") > 0).groupBy("host", "line_set").agg(F.first("lines").alias("lines"))
    lines = sets.select("host", "line_set", F.explode("lines").alias("line"))
    counted = lines.groupBy("host", "line").agg(F.count("*").alias("n")).where("n > 1")
    shared = core.cut(lines.join(counted, ["host", "line"]).select("host", "line_set", "line", "n"))
    documents = core.cut(distinct_documents(facts, facts.where(F.size("lines") > 0).select("host", "line_set").distinct(), shared))
    sizes = documents.select("host", "document").distinct().groupBy("host").agg(F.greatest(F.lit(float(min_docs)), F.count("*") * F.lit(share)).alias("bound"))
    often = shared.where(F.col("n") > min_docs).join(documents, ["host", "line_set"]).select("host", "line", "document").distinct()
    return often.groupBy("host", "line").agg(F.count("*").alias("n_docs")).join(sizes, "host").where("n_docs > bound")


def losses(facts: DataFrame, common: DataFrame) -> DataFrame:
    """(doc_id, host, row_key, lost_words, lost_lines): what rows lose; rows that keep all lines are absent.

    A hot line meets its many documents in salted shares of the join.
    """
    salts = 16
    mine = facts.select("doc_id", "host", "row_key", F.pmod("row_key", F.lit(salts)).alias("salt"),
                        F.explode(F.arrays_zip("lines", "line_words")).alias("x")).select("doc_id", "host", "row_key", "salt", F.col("x.lines").alias("line"), F.col("x.line_words").alias("words"))
    marks = common.select("host", "line", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    hit = mine.join(marks, ["host", "line", "salt"], "left_semi")
    return hit.distinct().groupBy("doc_id", "host", "row_key").agg(F.sum("words").alias("lost_words"), F.collect_set("line").alias("lost_lines"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = MIN_DOCS, share: float = SHARE) -> DataFrame:
    """Per row: base counts, words and line hashes lost to common lines, base_failed, depleted and kept."""
    facts = core.cut(line_facts(docs, id_col, text_col, host_col))
    lost = losses(facts, common_lines(facts, min_docs, share)).select(F.col("doc_id").alias("_id"), F.col("host").alias("_host"), F.col("row_key").alias("_key"), "lost_words", "lost_lines")
    left = F.col("n_words") - F.coalesce("lost_words", F.lit(0))
    same = F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_host") == F.col("host")) & (F.col("_key") == F.col("row_key"))
    return (facts.drop("lines", "line_words", "sketches", "line_set").join(lost, same, "left").drop("_id", "_host", "_key")
            .withColumn("base_failed", F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words"))
            .withColumn("depleted", F.col("lost_words").isNotNull() & ((left < LEFT_WORDS) | (left < F.col("n_words") * LEFT_SHARE)))
            .withColumn("kept", ~F.col("base_failed") & ~F.col("depleted")))


def _without(batches):
    """Texts without the lines whose hashes are listed."""
    for batch in batches:
        out = []
        for text, lost in zip(batch.column("text").to_pylist(), batch.column("lost_lines").to_pylist(), strict=True):
            if lost:
                gone = set(lost)
                text = "\n".join(x for x in text.split("\n") if not x.split() or line_hash(x.encode()) not in gone)
            out.append(text)
        at = batch.schema.get_field_index("text")
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if k == at else c for k, c in enumerate(batch.columns) if batch.schema.names[k] != "lost_lines"],
                                         names=[x for x in batch.schema.names if x != "lost_lines"])


def clean(docs: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE) -> DataFrame:
    """The kept documents with their columns, without the common lines."""
    rows = core.cut(judge(docs, min_docs=min_docs, share=share).select(F.col("doc_id").alias("_id"), F.col("host").alias("_host"), F.col("row_key").alias("_key"), "kept", "lost_lines"))
    ids = rows.where("kept").select(F.col("_id").alias("kept_id")).distinct()
    verdict = rows.join(ids, F.col("_id").eqNullSafe(F.col("kept_id")), "left_semi").groupBy("_id", "_host", "_key").agg(F.first("lost_lines").alias("lost_lines"))
    same = docs["doc_id"].eqNullSafe(F.col("_id")) & (F.coalesce(docs["source"], F.lit("")) == F.col("_host")) & (_row_key("text") == F.col("_key"))
    joined = docs.join(verdict, same).drop("_id", "_host", "_key")
    out = joined.mapInArrow(_without, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (SELECT doc_id, i, w[i:i+4] AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1))) AS i FROM d)),
again AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
repeats AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, range(5) r(k) GROUP BY doc_id),
lines AS (SELECT doc_id, host, unnest(string_split(t, chr(10))) AS line FROM d),
real_lines AS (SELECT doc_id, host, line, trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm,
                      len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM real_lines GROUP BY doc_id),
sets AS (SELECT host, hash AS s, list_distinct(flatten(list(x))) AS x FROM (SELECT doc_id, host, md5(string_agg(norm, chr(10) ORDER BY norm)) AS hash, list(norm) AS x
                 FROM (SELECT DISTINCT doc_id, host, norm FROM real_lines) GROUP BY doc_id, host) GROUP BY host, hash),
held AS (SELECT host, s, unnest(x) AS norm FROM sets),
uses AS (SELECT host, norm, count(*) AS n FROM held GROUP BY host, norm),
rarest AS (SELECT host, h.s, arg_min(norm, (n, md5_number_lower(norm) // 2)) AS norm FROM held h JOIN uses u USING (host, norm) WHERE n > 1 GROUP BY host, h.s),
numbers AS (SELECT host, s, held.norm, list_transform(string_split(held.norm, ' '), lambda x: md5_number_lower(x)::HUGEINT) AS v
              FROM held JOIN rarest USING (host, s) WHERE len(string_split(held.norm, ' ')) >= 6),
orders AS (SELECT * FROM (VALUES {orders}) o(j, a, b, c)),
marks AS (SELECT host, s, norm, j, min((v[i] * a + v[i + 1] * b + v[i + 2] * c) % 18446744073709551616) AS mark
            FROM (SELECT *, unnest(range(1, len(v) - 1)) AS i FROM numbers), orders GROUP BY host, s, norm, j),
alone AS (SELECT host, s, norm, count(*) OVER (PARTITION BY host, mark) AS c FROM marks),
novel AS (SELECT DISTINCT host, s FROM (SELECT host, s, norm FROM alone GROUP BY host, s, norm HAVING max(c) = 1)),
documents_of AS (SELECT host, sets.s, CASE WHEN novel.s IS NOT NULL OR rarest.s IS NULL THEN 'set ' || sets.s ELSE 'line ' || rarest.norm END AS document
                   FROM sets LEFT JOIN novel USING (host, s) LEFT JOIN rarest USING (host, s)),
sizes AS (SELECT host, greatest(5.0, count(DISTINCT document) * 0.05) AS bound FROM documents_of GROUP BY host),
counted AS (SELECT host, norm, count(DISTINCT document) AS n FROM held JOIN documents_of USING (host, s) GROUP BY host, norm),
common AS (SELECT host, norm FROM counted JOIN sizes USING (host) WHERE n > bound),
lost AS (SELECT doc_id, sum(n) AS n FROM real_lines JOIN common USING (host, norm) GROUP BY doc_id),
facts AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
       CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
       CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(repeats.n, 0) AS BIGINT) AS n_repeat_words, coalesce(lost.n, 0) AS gone
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN repeats USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT (gone > 0 AND (n_words - gone < 10 OR n_words - gone < 0.25 * n_words)) AS kept
FROM facts""".replace("{orders}", ", ".join(f"({j}, {a}::HUGEINT, {b}::HUGEINT, {c}::HUGEINT)" for j, (a, b, c) in enumerate(_ORDERS.tolist())))


@query("op10_line_quality", SQL)
def op10(spark, sf_dir):
    return judge(core.read(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
