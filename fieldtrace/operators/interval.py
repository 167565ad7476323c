"""Interval joins by clock buckets: equi join on (key, bucket), then the exact predicate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtrace.operators.asof import asof_join

FAN = 16  # each level's buckets are this much wider than the level below
MAX_SIZE = 1 << 60


def _sizes(width: int) -> list[int]:
    sizes = [width]
    while sizes[-1] * FAN < MAX_SIZE:
        sizes.append(sizes[-1] * FAN)
    return sizes


def _size(level: str, width: int) -> Column:
    return F.get(F.array(*[F.lit(s).cast("long") for s in _sizes(width)]), F.col(level))


def _levels(spans: DataFrame, length: Column, width: int) -> tuple[DataFrame, list[int]]:
    sizes = _sizes(width)
    level = F.lit(len(sizes) - 1)
    for i in reversed(range(len(sizes) - 1)):
        level = F.when(length <= F.lit(sizes[i]), F.lit(i)).otherwise(level)
    leveled = spans.withColumn("_level", level)
    present = sorted(r[0] for r in leveled.select("_level").distinct().collect())  # one row per level, at most 16
    return leveled, present


def span_pairs(points: DataFrame, spans: DataFrame, keys: list[str], t: str, start: str, end: str,
               width: int, closed: str = "both", max_length: int | None = None) -> DataFrame:
    """All (point, span) pairs with the point inside the span (``closed`` both, left, right, none).

    A span is placed at the bucket level that fits its length, so it fills at most two buckets and
    a point is copied once per level in use. ``max_length`` <= ``width`` promises one level.
    ``spans`` columns other than the keys must not clash with those of ``points``.
    """
    if max_length is not None and max_length <= width:
        leveled, present = spans.withColumn("_level", F.lit(0)), [0]
    else:
        leveled, present = _levels(spans, F.col(end) - F.col(start), width)
    size = _size("_level", width)
    right = leveled.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in spans.columns if c not in keys], "_level",
        F.explode(F.sequence(F.floor(F.col(start) / size), F.floor(F.col(end) / size))).alias("_bucket"))
    left = points.withColumn("_plevel", F.explode(F.array(*[F.lit(v) for v in present])) if present
                             else F.lit(0))
    left = left.withColumn("_pbucket", F.floor(F.col(t) / _size("_plevel", width)))
    cond = (F.col("_plevel") == F.col("_level")) & (F.col("_pbucket") == F.col("_bucket"))
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"_k_{k}"))
    lo = F.col(t) >= F.col(start) if closed in ("both", "left") else F.col(t) > F.col(start)
    hi = F.col(t) <= F.col(end) if closed in ("both", "right") else F.col(t) < F.col(end)
    return left.join(right, cond & lo & hi).drop("_plevel", "_pbucket", "_level", "_bucket",
                                                 *[f"_k_{k}" for k in keys])


def pick_span(points: DataFrame, pairs: DataFrame, point_id: list[str], take: list[str],
              first_by: list[Column]) -> DataFrame:
    """Left join of each point to its best pair: smallest ``first_by``."""
    best = pairs.groupBy(*point_id).agg(
        F.min_by(F.struct(*take), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(first_by)])).alias("_best"))
    return points.join(best, point_id, "left").select(
        *points.columns, *[F.col(f"_best.{c}").alias(c) for c in take])


def first_containing(points: DataFrame, spans: DataFrame, keys: list[str], point_id: list[str], t: str,
                     start: str, end: str, take: list[str], order: list[str], width: int,
                     closed: str = "both") -> DataFrame:
    """JOIN-04 / JOIN-13: the first span (by ``order``) that contains the point, or null."""
    pairs = span_pairs(points, spans, keys, t, start, end, width, closed)
    return pick_span(points, pairs, point_id, take, [F.col(c) for c in order])


def containing_else_last(points: DataFrame, spans: DataFrame, keys: list[str], point_id: list[str], t: str,
                         start: str, end: str, label: str, span_id: str, width: int,
                         hot_rows: int | None = None) -> DataFrame:
    """JOIN-05: label of the first containing span, else of the span that ended last before the point."""
    inside = first_containing(points, spans.select(*keys, start, end, span_id, F.col(label).alias("_in")),
                              keys, point_id, t, start, end, ["_in", span_id], [start, span_id], width)
    inside = inside.withColumnRenamed(span_id, "_in_id")
    ended = asof_join(inside, spans.withColumn("_neg", -F.col(span_id)), keys, t, end,
                      {"_before": label, "_before_id": span_id}, allow_equal=False, tie=("_neg",),
                      hot_rows=hot_rows)
    contained = F.col("_in_id").isNotNull()
    return ended.select(
        *points.columns, F.when(contained, F.col("_in")).otherwise(F.col("_before")).alias(label),
        F.when(contained, F.col("_in_id")).otherwise(F.col("_before_id")).alias(span_id),
        contained.alias("inside"))


def padded_latest(left: DataFrame, right: DataFrame, keys: list[str], left_id: list[str], start: str, end: str,
                  right_t: str, take: list[str], pad: int, width: int) -> DataFrame:
    """JOIN-07: right row nearest to the left span (0 inside), at most ``pad`` away; ties go to the latest."""
    spans = left.select(*keys, *[F.col(c).alias(f"_id_{c}") for c in left_id],
                        F.col(start).alias("_s"), F.col(end).alias("_e"),
                        (F.col(start) - pad).alias("_lo"), (F.col(end) + pad).alias("_hi"))
    pairs = span_pairs(right, spans, keys, right_t, "_lo", "_hi", width)
    dist = F.greatest(F.col("_s") - F.col(right_t), F.col(right_t) - F.col("_e"), F.lit(0))
    best = pairs.groupBy(*[f"_id_{c}" for c in left_id]).agg(
        F.max_by(F.struct(*take, dist.alias("distance")), F.struct((-dist).alias("d"), F.col(right_t).alias("t"))).alias("_b"))
    best = best.select(*[F.col(f"_id_{c}").alias(c) for c in left_id], "_b")
    return left.join(best, left_id, "left").select("*", *[F.col(f"_b.{c}").alias(c) for c in [*take, "distance"]]).drop("_b")


def attach_in_slack(spans: DataFrame, rows: DataFrame, keys: list[str], start: str, end: str, t: str,
                    slack: int, width: int) -> DataFrame:
    """JOIN-08: every row within ``slack`` of a span, once per span (many to many)."""
    wide = spans.withColumn("_lo", F.col(start) - slack).withColumn("_hi", F.col(end) + slack)
    return span_pairs(rows, wide, keys, t, "_lo", "_hi", width).drop("_lo", "_hi")


def overlap_pairs(left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str],
                  right_span: tuple[str, str], width: int) -> DataFrame:
    """Pairs of spans sharing positive length, found once each.

    Two spans overlap when one starts inside the other, so this is two bucketed point-in-span joins.
    """
    ls, le = left_span
    rs, re = right_span
    rcols = [c for c in right.columns if c not in keys]
    a = span_pairs(left, right, keys, ls, rs, re, width, "left")
    lcols = [c for c in left.columns if c not in keys]
    b = span_pairs(right, left.select(*keys, *lcols), keys, rs, ls, le, width, "none")
    cols = [*keys, *lcols, *rcols]
    both = a.select(*cols).unionByName(b.select(*cols))
    return both.withColumn("overlap", F.least(le, re) - F.greatest(ls, rs)).filter("overlap > 0")


def span_supply(windows: DataFrame, spans: DataFrame, keys: list[str], window_id: list[str],
                window: tuple[str, str], span: tuple[str, str], width: int, share: float) -> DataFrame:
    """JOIN-30: any overlap, and whether one span covers at least ``share`` of the window."""
    pairs = overlap_pairs(windows, spans, keys, window, span, width)
    best = pairs.groupBy(*window_id).agg(F.max("overlap").alias("best_overlap"), F.count(F.lit(1)).alias("n_spans"))
    out = windows.join(best, window_id, "left")
    length = F.col(window[1]) - F.col(window[0])
    return out.select(
        *windows.columns, F.coalesce("best_overlap", F.lit(0)).alias("best_overlap"),
        F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.col("best_overlap").isNotNull().alias("any_overlap"),
        F.coalesce(F.col("best_overlap") >= length * F.lit(share), F.lit(False)).alias("covered"))


def asof_revision(targets: DataFrame, reviews: DataFrame, keys: list[str], target_id: list[str], t: str,
                  start: str, end: str, value: str, revision: str, width: int) -> DataFrame:
    """JOIN-19: reviews whose ``[start, end)`` covers the target: all alternatives in revision order,
    the last revision selected."""
    pairs = span_pairs(targets, reviews, keys, t, start, end, width, "left")
    agg = pairs.groupBy(*target_id).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(revision, value))), lambda r: r[value]).alias("alternatives"),
        F.max_by(value, revision).alias("selected"), F.max(revision).alias("revision"))
    return targets.join(agg, target_id, "left").select(
        *targets.columns, "alternatives", "selected", F.col("revision"))


def first_after(anchors: DataFrame, rows: DataFrame, keys: list[str], anchor_id: list[str], t: str, limit: str,
                row_t: str, take: dict[str, str], width: int, open_left: bool = True) -> DataFrame:
    """WIN-23 / AGG-45: first row in ``(t, limit]`` of each anchor (nulls where there is none)."""
    spans = anchors.select(*keys, *[F.col(c).alias(f"_id_{c}") for c in anchor_id],
                           F.col(t).alias("_s"), F.col(limit).alias("_e"))
    pairs = span_pairs(rows, spans, keys, row_t, "_s", "_e", width, "right" if open_left else "both")
    best = pairs.groupBy(*[f"_id_{c}" for c in anchor_id]).agg(
        F.min_by(F.struct(*[F.col(c).alias(a) for a, c in take.items()]), row_t).alias("_b"))
    best = best.select(*[F.col(f"_id_{c}").alias(c) for c in anchor_id], "_b")
    return anchors.join(best, anchor_id, "left").select(
        *anchors.columns, *[F.col(f"_b.{a}").alias(a) for a in take])


def neighbours_within(df: DataFrame, keys: list[str], row_id: str, t: str, reach: int, cols: list[str]) -> DataFrame:
    """JOIN-26, self range join: pairs of different rows of a key at most ``reach`` apart on the clock."""
    spans = df.select(*keys, F.col(row_id).alias("_id"), *[F.col(c).alias(f"_{c}") for c in cols],
                      F.col(t).alias("_at"), (F.col(t) - reach).alias("_lo"), (F.col(t) + reach).alias("_hi"))
    width = 2 * reach + 1
    return span_pairs(df, spans, keys, t, "_lo", "_hi", width, max_length=width).filter(
        F.col(row_id) != F.col("_id")).drop("_lo", "_hi")
