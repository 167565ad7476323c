"""Leakage-safe splits and quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtrace.operators.ordered import row_number, running_sum, scan, top_k


def hash_order(ids: DataFrame, ident: str, salt: str = "") -> DataFrame:
    """Ids with the sha256 that orders them."""
    return ids.withColumn("_h", F.sha2(F.concat(F.lit(salt), F.col(ident).cast("string")), 256))


def hashed_tail_split(ids: DataFrame, group: list[str], ident: str, take: int, dev: int, test: int) -> DataFrame:
    """AGG-47: the first ``take`` ids of each group by sha256; of those the last ``test`` are test, the ``dev``
    before them dev, the rest train. Only ``take`` rows per group leave a task."""
    d = top_k(hash_order(ids, ident), group, [F.col("_h"), F.col(ident)], take, "_r")
    n = d.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")) if group else d.agg(F.count(F.lit(1)).alias("_n"))
    d = d.join(n, group) if group else d.join(F.broadcast(n), F.lit(True))  # one-row count
    back = F.col("_n") - F.col("_r")
    split = F.when(back < test, "test").when(back < test + dev, "dev").otherwise("train")
    return d.select(*group, ident, split.alias("split"))


def chronological_split(rows: DataFrame, keys: list[str], order: list[str], shares: tuple[float, float] = (0.6, 0.2), hot_rows: int | None = None) -> DataFrame:
    """AGG-47: earliest 60 % train, next 20 % dev, rest test, by position in time within each key."""
    d = scan(rows, keys, order, {"_r": row_number()}, hot_rows)
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    d = d.join(n, keys)
    a, b = F.floor(F.col("_n") * shares[0]), F.floor(F.col("_n") * (shares[0] + shares[1]))
    return d.withColumn("split", F.when(F.col("_r") <= a, "train").when(F.col("_r") <= b, "dev").otherwise("test")).drop("_r", "_n")


def is_validation(key: Column, percent: int) -> Column:
    """AGG-47: sha1 of the key modulo 100 below ``percent`` (first eight hex digits)."""
    return F.conv(F.substring(F.sha1(key), 1, 8), 16, 10).cast("long") % 100 < percent


def fill_by_size(groups: DataFrame, keys: list[str], ident: str, size: str, share: float, hot_rows: int | None = None) -> DataFrame:
    """AGG-47: whole videos, largest first, go to the training side until it holds ``share`` of the rows."""
    d = scan(groups.withColumn("_neg", -F.col(size)), keys, ["_neg", ident], {"_before": running_sum(F.col(size), inclusive=False)}, hot_rows)
    total = groups.groupBy(*keys).agg(F.sum(size).alias("_t"))
    d = d.join(total, keys)
    train = F.coalesce("_before", F.lit(0)) < F.col("_t") * share
    return d.withColumn("split", F.when(train, "train").otherwise("valid")).drop("_neg", "_before", "_t")


def pinned_split(rows: DataFrame, pinned: DataFrame, keys: list[str]) -> DataFrame:
    """AGG-47: named keys are validation, the rest training."""
    p = pinned.select(*keys).distinct().withColumn("_p", F.lit(True))
    return rows.join(p, keys, "left").withColumn("split", F.when(F.col("_p"), "valid").otherwise("train")).drop("_p")


def round_robin(rows: DataFrame, keys: list[str], stratum: str, order: list[str], quota: int, hot_rows: int | None = None) -> DataFrame:
    """AGG-47: ``quota`` rows per key taken in turns over the strata: first of each, then second of each, ..."""
    d = scan(rows, [*keys, stratum], order, {"_turn": row_number()}, hot_rows)
    return top_k(d, keys, [F.col("_turn"), F.col(stratum), *[F.col(c) for c in order]], quota, "pick").drop("_turn")
