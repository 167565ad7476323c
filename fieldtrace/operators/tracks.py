"""Track-level helpers: times of frames, what-if moves, summaries and samples of a track."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtrace.operators.ordered import row_number, scan, top_k
from fieldtrace.operators.islands import island_ids


def frame_time(rows: DataFrame, spans: DataFrame, keys: list[str], frame: str) -> DataFrame:
    """FN-16: time of a frame by linear interpolation in its track's (f0, f1, t0, t1) span, clamped;
    a null frame takes the span start."""
    d = rows.join(spans, keys)
    share = (F.col(frame) - F.col("f0")).cast("double") / F.greatest(F.col("f1") - F.col("f0"), F.lit(1))
    share = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))
    moved = F.col("t0") + ((F.col("t1") - F.col("t0")) * share).cast("long")
    return d.withColumn("at_us", F.when(F.col(frame).isNull(), F.col("t0")).otherwise(moved))


def what_if(df: DataFrame, x: Column, y: Column, dx: float, dy: float, features: dict, limit: float = 10.0,
            length: float = 105.0, width: float = 68.0) -> DataFrame:
    """FN-28: change of each feature when one player moves by at most ``limit`` inside the pitch."""
    if (dx * dx + dy * dy) ** 0.5 > limit:
        raise ValueError(f"a scenario moves one player at most {limit} m")
    sx = F.least(F.greatest(x + dx, F.lit(0.0)), F.lit(length))
    sy = F.least(F.greatest(y + dy, F.lit(0.0)), F.lit(width))
    return df.select("*", *[(fn(sx, sy) - fn(x, y)).alias(n) for n, fn in features.items()])


def tracklet_summary(df: DataFrame, keys: list[str], frame: str, t: str, conf: str) -> DataFrame:
    """AGG-01: first and last frame and time, row count and mean confidence (sum kept beside it)."""
    return df.groupBy(*keys).agg(
        F.min(frame).alias("frame_start"), F.max(frame).alias("frame_end"), F.min(t).alias("ts_start"),
        F.max(t).alias("ts_end"), F.count(F.lit(1)).alias("n_detections"), (F.sum(conf) / F.count(conf)).alias("mean_conf"))


def tallest_per_track(df: DataFrame, keys: list[str], height: str, tie: list[str], k: int) -> DataFrame:
    """ORD-04 / SRC-28: the ``k`` tallest rows of each track."""
    return top_k(df, keys, [F.col(height).desc(), *[F.col(c) for c in tie]], k)


def evenly_spaced(df: DataFrame, keys: list[str], order: list[str], k: int, hot_rows: int | None = None) -> DataFrame:
    """ORD-04: ``k`` evenly spaced rows per key, first and last included (all rows when fewer)."""
    d = scan(df, keys, order, {"_rn": row_number()}, hot_rows)
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    d = d.join(n, keys)
    picks = F.transform(F.sequence(F.lit(0), F.lit(k - 1)),
                        lambda j: F.floor(j * (F.col("_n") - 1) / F.lit(max(k - 1, 1))))
    keep = (F.col("_n") <= k) | F.array_contains(picks, F.col("_rn") - 1)
    return d.filter(keep).drop("_rn", "_n")


def systematic_sample(df: DataFrame, keys: list[str], order: list[str], every: int, cap: int | None = None,
                      hot_rows: int | None = None) -> DataFrame:
    """ORD-09: every n-th row of a key in order, at most ``cap`` of them when the plan names one."""
    d = scan(df, keys, order, {"_rn": row_number()}, hot_rows)
    keep = (F.col("_rn") - 1) % every == 0
    if cap is not None:
        keep = keep & ((F.col("_rn") - 1) / every < cap)
    return d.filter(keep).drop("_rn")
