"""The corpus pipeline: quality rules, near-duplicates, repeated passages, benchmark passages, SentencePiece ids.

Each stage takes and returns a DataFrame with the columns of ``documents`` (the last returns ids instead of texts); it is
written as Parquet and reread as the next one's input. Rows with null ids or texts, repeated rows and further columns
pass through as the operators define; an empty table stays empty.
"""

from __future__ import annotations

import uuid

from fieldtrace.llm import decontaminate, line_quality, near_dedup, sentence_pieces, substring_dedup
from fieldtrace.session import ensure_checkpoint_dir, ship

#: SQL can't express fingerprints within a Hamming radius or merges by priority, so there is none for the whole.
ORACLE_SQL = None


def quality(spark, docs, sf_dir):
    """Documents that the quality rules keep, without the lines that their host repeats."""
    ship(spark)
    return line_quality.clean(docs)


def near_duplicates(spark, docs, sf_dir):
    """One document of each group of near-duplicates: the one with the smallest doc_id."""
    ship(spark)
    return near_dedup.one_of_each(docs)


def passages(spark, docs, sf_dir):
    """All documents, without passages of 50 words or more that an earlier document has."""
    ship(spark)
    return substring_dedup.without_repeats(docs)


def benchmark(spark, docs, sf_dir):
    """Documents that hold no benchmark item."""
    ship(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pieces(spark, docs, sf_dir):
    """SentencePiece ids of whole texts, and whether they decode to the text."""
    ship(spark)
    return sentence_pieces.round_trip(docs, with_ids=True)


STAGES = [("quality", quality), ("near_dedup", near_duplicates), ("substring_dedup", passages), ("decontaminate", benchmark), ("sentence_pieces", pieces)]


def run(spark, sf_dir):
    """All stages on ``documents``; what lies between them is in the shared folder."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}_{name}")
        docs = spark.read.parquet(f"{folder}/{k}_{name}")
    return docs
