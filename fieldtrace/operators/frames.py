"""Bounded ROWS/RANGE frames that do not pull a whole key into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldtrace.operators.ordered import SMALL_BYTES, row_number, running_sum, scan
from fieldtrace.session import plan_bytes


def range_frame(df: DataFrame, keys: list[str], clock: str, lo: int, hi: int, aggs: dict[str, Column],
                tie: list[str] | None = None, split: bool | None = None) -> DataFrame:
    """Aggregates over rows of the same key with clock in ``[t+lo, t+hi]``.

    On large inputs a row is copied to each clock bucket whose frames can see it, so a key is
    spread over its buckets and a task holds one bucket plus its halo.
    """
    if split is None:
        size = plan_bytes(df)
        split = size is None or size > SMALL_BYTES
    if not split:
        w = Window.partitionBy(*keys).orderBy(clock).rangeBetween(lo, hi)
        return df.select("*", *[a.over(w).alias(n) for n, a in aggs.items()])
    width = max(hi, 0) - min(lo, 0) + 1
    width *= 8
    home = F.floor(F.col(clock) / F.lit(width))
    halo = df.withColumn("_b", F.explode(F.sequence(
        F.floor((F.col(clock) - F.lit(max(hi, 0))) / F.lit(width)),
        F.floor((F.col(clock) - F.lit(min(lo, 0))) / F.lit(width)))))
    w = Window.partitionBy(*keys, "_b").orderBy(clock).rangeBetween(lo, hi)
    out = halo.select("*", *[a.over(w).alias(n) for n, a in aggs.items()])
    return out.filter(F.col("_b") == home).drop("_b")


def rows_frame(df: DataFrame, keys: list[str], order: list[str], lo: int, hi: int,
               aggs: dict[str, Column], split: bool | None = None,
               hot_rows: int | None = None) -> DataFrame:
    """WIN-24 / WIN-41: aggregates over the rows at positions ``lo..hi`` around each row (fewer at the ends)."""
    numbered = scan(df, keys, order, {"_rn": row_number()}, hot_rows)
    return range_frame(numbered, keys, "_rn", lo, hi, aggs, split=split).drop("_rn")


def count_in_window(df: DataFrame, keys: list[str], clock: str, width: int, count: str = "n",
                    hot_rows: int | None = None) -> DataFrame:
    """Rows of the key in ``[t, t+width)`` for each row, from differences of running counts."""
    starts = df.select(*keys, F.col(clock).alias("_t"), F.lit(1).alias("_side"), F.lit(1).alias("_one"),
                       F.struct(*df.columns).alias("_row"))
    # a probe sorts before rows at its own instant, so it counts rows strictly before it
    probes = df.select(*keys, (F.col(clock) + width).alias("_t"), F.lit(0).alias("_side"),
                       F.lit(0).alias("_one"), F.struct(*df.columns).alias("_row"))
    begin = df.select(*keys, F.col(clock).alias("_t"), F.lit(0).alias("_side"), F.lit(-1).alias("_one"),
                      F.struct(*df.columns).alias("_row"))
    both = starts.unionByName(probes).unionByName(begin)
    counted = scan(both.withColumn("_add", F.greatest("_one", F.lit(0))), keys, ["_t", "_side"],
                   {"_cum": running_sum(F.col("_add"))}, hot_rows)
    return (
        counted.filter("_side = 0")
        .groupBy("_row").agg(F.sum(F.when(F.col("_one") == 0, F.col("_cum")).otherwise(-F.col("_cum"))).alias(count))
        .select("_row.*", count)
    )


def densest_window(df: DataFrame, keys: list[str], clock: str, width: int,
                   hot_rows: int | None = None) -> DataFrame:
    """WIN-40: start of the fullest ``[t, t+width)`` window per key; earliest start wins ties."""
    counted = count_in_window(df, keys, clock, width, "n", hot_rows)
    return counted.groupBy(*keys).agg(
        F.max_by(F.struct(F.col(clock).alias("start"), "n"), F.struct("n", -F.col(clock))).alias("_b")
    ).select(*keys, "_b.start", "_b.n")
