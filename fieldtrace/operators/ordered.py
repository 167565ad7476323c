"""Ordered scans per key (lag, lead, fills, running totals) that survive a hot key.

A plain ``Window.partitionBy(key)`` sorts each key in one task. When one key holds a large
share of the rows that task is the whole job, so :func:`scan` cuts a hot key into slices of about
``hot_rows`` rows at quantiles of the full order, scans each slice, scans the one-row-per-slice summaries, and joins
the carried value back. Keys below the bound keep the single-window plan; a small input
(by Catalyst's own size estimate) skips the check.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from fieldtrace.session import cut_lineage, plan_bytes

HOT_ROWS = 2_000_000  # rows of one key that one task may sort
SMALL_BYTES = 128 * 1024 * 1024  # inputs below this cannot hold a key worth splitting
BROADCAST_ROWS = 200_000  # checked bound for the slice tables


@dataclass(frozen=True)
class Scan:
    """One scanned column: ``kind`` applied to ``value`` along the order."""

    kind: str
    value: Column | None = None
    inclusive: bool = True


def prev(value: Column) -> Scan:
    return Scan("prev", value)


def next_(value: Column) -> Scan:
    return Scan("next", value)


def fill_forward(value: Column, inclusive: bool = True) -> Scan:
    """Last non-null value at or before the row (before it when not ``inclusive``)."""
    return Scan("ffill", value, inclusive)


def fill_back(value: Column, inclusive: bool = True) -> Scan:
    """First non-null value at or after the row (after it when not ``inclusive``)."""
    return Scan("bfill", value, inclusive)


def running_sum(value: Column, inclusive: bool = True) -> Scan:
    return Scan("sum", value, inclusive)


def remaining_sum(value: Column) -> Scan:
    """Sum from the row to the end of its key."""
    return Scan("rsum", value)


def running_max(value: Column, inclusive: bool = True) -> Scan:
    return Scan("max", value, inclusive)


def running_min(value: Column, inclusive: bool = True) -> Scan:
    return Scan("min", value, inclusive)


def row_number() -> Scan:
    return Scan("rownum", None)


def same_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & a[k].eqNullSafe(b[k])
    return cond


SAMPLED = 64  # sampled rows per slice, from which its bounds are taken
_STRIDE = 64  # bounds are looked up in two steps of about this many comparisons


def hot_slices(df: DataFrame, keys: list[str], order: list[str], hot_rows: int) -> DataFrame | None:
    """(keys, _bounds): for each key above ``hot_rows`` the first positions of its slices but the first, in order.

    Bounds are quantiles of a sample of full positions (all columns of ``order``), so one far clock or a storm of equal
    clocks leaves the slices even. The sample is taken by hash, the same on every recomputation. Returns None when no
    key is hot.
    """
    stats = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows)
    n_hot = stats.count()
    if n_hot == 0:
        return None
    stats = stats.select(*[F.col(k).alias(f"_s_{k}") for k in keys])
    side = F.broadcast(stats) if n_hot <= BROADCAST_ROWS else stats
    cond = F.lit(True)
    for k in keys:
        cond = cond & df[k].eqNullSafe(F.col(f"_s_{k}"))
    thin = max(1, hot_rows // SAMPLED)
    drawn = df.filter(F.pmod(F.xxhash64(*order), F.lit(thin)) == 0).join(side, cond)
    each = max(1, hot_rows // thin)
    positions = drawn.groupBy(*[f"_s_{k}" for k in keys]).agg(F.array_sort(F.collect_set(F.struct(*order))).alias("_p"))
    picked = F.transform(F.sequence(F.lit(1), F.floor((F.size("_p") - 1) / each).cast("int")), lambda i: F.element_at("_p", i * each + 1))
    return positions.filter(F.size("_p") > each).select(*[f"_s_{k}" for k in keys], picked.alias("_bounds"))


def _slice_of(position: Column, bounds: Column) -> Column:
    """Number of bounds at or before the position: every 64th bound first, then those behind it."""
    before = lambda some: F.size(F.filter(some, lambda b: b <= position))
    coarse = F.transform(F.sequence(F.lit(1), F.ceil(F.size(bounds) / _STRIDE).cast("int")), lambda i: F.element_at(bounds, (i - 1) * _STRIDE + 1))
    skipped = F.greatest(before(coarse) - 1, F.lit(0)) * _STRIDE
    return (skipped + before(F.slice(bounds, skipped + 1, F.lit(_STRIDE)))).cast("long")


def with_slices(df: DataFrame, keys: list[str], order: list[str] | str, hot_rows: int | None = None) -> DataFrame | None:
    """``df`` with ``_slice`` (null for keys that are not hot), or None when no key is hot.

    The sliced rows are written once, so that scans upon scans read them instead of repeating what came before.
    """
    order = [order] if isinstance(order, str) else list(order)
    if hot_rows is None:
        size = plan_bytes(df)
        if size is not None and size <= SMALL_BYTES:
            return None
        hot_rows = HOT_ROWS
    slices = hot_slices(df, keys, order, hot_rows)
    if slices is None:
        return None
    slices = cut_lineage(slices)
    n_bounds = slices.agg(F.sum(F.size("_bounds")).alias("n")).first()["n"] or 0
    hint = F.broadcast if n_bounds <= BROADCAST_ROWS else (lambda x: x)
    cond = F.lit(True)
    for k in keys:
        cond = cond & df[k].eqNullSafe(F.col(f"_s_{k}"))
    position = F.struct(*[df[c] for c in order])
    sliced = df.join(hint(slices), cond, "left").withColumn("_slice", F.when(F.col("_bounds").isNotNull(), _slice_of(position, F.col("_bounds"))))
    written = cut_lineage(sliced.select(*df.columns, "_slice"))
    return written.select(*[F.col(f"`{c}`").alias(c) for c in written.columns])


def _local(op: Scan, value: Column | None, fwd, back) -> Column:
    upto = fwd.rowsBetween(Window.unboundedPreceding, 0 if op.inclusive else -1)
    if op.kind == "prev":
        return F.lag(value).over(fwd)
    if op.kind == "next":
        return F.lead(value).over(fwd)
    if op.kind == "ffill":
        return F.last(value, ignorenulls=True).over(upto)
    if op.kind == "bfill":  # reversed order: a following frame would be quadratic
        return F.last(value, ignorenulls=True).over(
            back.rowsBetween(Window.unboundedPreceding, 0 if op.inclusive else -1))
    if op.kind == "sum":
        return F.sum(value).over(upto)
    if op.kind == "rsum":
        return F.sum(value).over(back.rowsBetween(Window.unboundedPreceding, 0))
    if op.kind == "max":
        return F.max(value).over(upto)
    if op.kind == "min":
        return F.min(value).over(upto)
    if op.kind == "rownum":
        return F.row_number().over(fwd).cast("long")
    raise ValueError(op.kind)


def scan(df: DataFrame, keys: list[str], order: list[str], ops: dict[str, Scan],
         hot_rows: int | None = None) -> DataFrame:
    """Add one column per entry of ``ops``, evaluated along ``order`` within ``keys``.

    ``order`` must be a total order; a hot key is cut along it.
    """
    sliced = with_slices(df, keys, order, hot_rows) if keys else None
    if sliced is None:
        fwd = Window.partitionBy(*keys).orderBy(*order)
        back = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
        return df.select("*", *[_local(op, op.value, fwd, back).alias(a) for a, op in ops.items()])

    part = [*keys, "_slice"]
    fwd = Window.partitionBy(*part).orderBy(*order)
    back = Window.partitionBy(*part).orderBy(*[F.col(c).desc() for c in order])
    valued = sliced.select("*", *[op.value.alias(f"_v_{a}") for a, op in ops.items() if op.value is not None])
    local = valued.select(
        "*", F.row_number().over(fwd).alias("_first"), F.row_number().over(back).alias("_last"),
        *[_local(op, F.col(f"_v_{a}") if op.value is not None else None, fwd, back).alias(f"_l_{a}")
          for a, op in ops.items()],
    )
    pos = F.struct(*order)
    aggs = []
    for a, op in ops.items():
        v = F.col(f"_v_{a}")
        box = F.struct(v.alias("v"))
        aggs.append({
            "prev": lambda: F.max_by(box, pos), "next": lambda: F.min_by(box, pos),
            "ffill": lambda: F.max_by(box, F.when(v.isNotNull(), pos)),
            "bfill": lambda: F.min_by(box, F.when(v.isNotNull(), pos)),
            "sum": lambda: F.struct(F.sum(v).alias("v")), "rsum": lambda: F.struct(F.sum(v).alias("v")), "max": lambda: F.struct(F.max(v).alias("v")),
            "min": lambda: F.struct(F.min(v).alias("v")),
            "rownum": lambda: F.struct(F.count(F.lit(1)).alias("v")),
        }[op.kind]().alias(f"_a_{a}"))
    summary = valued.filter(F.col("_slice").isNotNull()).groupBy(*part).agg(*aggs)
    sw = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sb = Window.partitionBy(*keys).orderBy(F.col("_slice").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry = []
    for a, op in ops.items():
        box, v = F.col(f"_a_{a}"), F.col(f"_a_{a}.v")
        carry.append({
            "prev": lambda: F.last(box, ignorenulls=True).over(sw)["v"],
            "next": lambda: F.last(box, ignorenulls=True).over(sb)["v"],
            "ffill": lambda: F.last(v, ignorenulls=True).over(sw),
            "bfill": lambda: F.last(v, ignorenulls=True).over(sb),
            "sum": lambda: F.sum(v).over(sw), "rsum": lambda: F.sum(v).over(sb), "max": lambda: F.max(v).over(sw),
            "min": lambda: F.min(v).over(sw), "rownum": lambda: F.sum(v).over(sw),
        }[op.kind]().alias(f"_c_{a}"))
    carried = summary.select(*[F.col(c).alias(f"_j_{c}") for c in part], *carry)
    cond = F.lit(True)
    for c in part:
        cond = cond & (local[c].eqNullSafe(F.col(f"_j_{c}")) if c != "_slice" else local[c] == F.col("_j__slice"))
    joined = local.join(carried, cond, "left")
    out = []
    for a, op in ops.items():
        lv, cv = F.col(f"_l_{a}"), F.col(f"_c_{a}")
        if op.kind == "prev":
            res = F.when(F.col("_first") == 1, cv).otherwise(lv)
        elif op.kind == "next":
            res = F.when(F.col("_last") == 1, cv).otherwise(lv)
        elif op.kind in ("ffill", "bfill"):
            res = F.coalesce(lv, cv)
        elif op.kind in ("sum", "rsum", "rownum"):
            res = F.coalesce(lv + cv, lv, cv)
        elif op.kind == "max":
            res = F.greatest(lv, cv)
        else:
            res = F.least(lv, cv)
        out.append(res.alias(a))
    return joined.select(*df.columns, *out)


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key; Spark prunes to ``k`` per task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)
