"""Gaps-and-islands operators: runs, spans, transitions, segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtrace.operators.ordered import (
    fill_forward, next_, prev, running_max, running_sum, scan,
)


def island_ids(df: DataFrame, keys: list[str], order: list[str], label: Column | None = None,
               max_gap: int | None = None, out: str = "run", hot_rows: int | None = None) -> DataFrame:
    """Number the islands of each key: a row opens one when the label changes or the clock jumps."""
    clock = F.col(order[0])
    packed = F.struct(clock.alias("t"), (label if label is not None else F.lit(0)).alias("l"))
    d = scan(df, keys, order, {"_p": prev(packed)}, hot_rows)
    opens = F.col("_p").isNull()
    if label is not None:
        opens = opens | ~F.col("_p.l").eqNullSafe(label)
    if max_gap is not None:
        opens = opens | ((clock - F.col("_p.t")) > max_gap)
    d = d.withColumn("_o", opens.cast("long")).drop("_p")
    return scan(d, keys, order, {out: running_sum(F.col("_o"))}, hot_rows).drop("_o")


def label_runs(df: DataFrame, keys: list[str], order: list[str], label: str, max_gap: int,
               min_length: int = 0, hot_rows: int | None = None) -> DataFrame:
    """WIN-01: runs of one label bridged over gaps up to ``max_gap``; short runs are dropped
    and the remaining ones renumbered from 0 per key."""
    clock = order[0]
    d = island_ids(df, keys, order, F.col(label), max_gap, "_run", hot_rows)
    runs = d.groupBy(*keys, "_run").agg(
        F.first(label).alias(label), F.min(clock).alias("start"), F.max(clock).alias("end"),
        F.count(F.lit(1)).alias("n"),
    ).filter(F.col("end") - F.col("start") >= min_length)
    return scan(runs, keys, ["_run"], {"_k": running_sum(F.lit(1))}, hot_rows).select(
        *keys, (F.col("_k") - 1).alias("run_id"), label, "start", "end", "n")


def merge_spans(df: DataFrame, keys: list[str], start: str, end: str, max_gap: int = 0,
                hot_rows: int | None = None) -> DataFrame:
    """WIN-04: union of overlapping or nearly touching spans (gap <= ``max_gap``).

    Equal spans are one counted row of both scans: their order would be open, and could differ from scan to scan.
    """
    counted = df.groupBy(*keys, start, end).agg(F.count(F.lit(1)).alias("_n"))
    d = scan(counted, keys, [start, end], {"_m": running_max(F.col(end), inclusive=False)}, hot_rows)
    opens = (F.col("_m").isNull() | (F.col(start) - F.col("_m") > max_gap)).cast("long")
    d = scan(d.withColumn("_o", opens), keys, [start, end], {"_g": running_sum(F.col("_o"))}, hot_rows)
    return d.groupBy(*keys, "_g").agg(
        F.min(start).alias("start"), F.max(end).alias("end"), F.sum("_n").alias("n")).drop("_g")


def live_spans(df: DataFrame, keys: list[str], clock: str, max_gap: int,
               hot_rows: int | None = None) -> DataFrame:
    """WIN-04: spans of readings no more than ``max_gap`` apart; single readings are not spans."""
    d = island_ids(df, keys, [clock], None, max_gap, "_run", hot_rows)
    return d.groupBy(*keys, "_run").agg(
        F.min(clock).alias("start"), F.max(clock).alias("end"), F.count(F.lit(1)).alias("n"),
    ).filter(F.col("end") > F.col("start")).drop("_run")


def complement_spans(spans: DataFrame, keys: list[str], bounds: DataFrame, pad: int = 0,
                     min_length: int = 1, hot_rows: int | None = None) -> DataFrame:
    """WIN-04: parts of each key's ``[lo, hi]`` bound outside every padded span."""
    padded = spans.select(*keys, (F.col("start") - pad).alias("start"), (F.col("end") + pad).alias("end"))
    merged = merge_spans(padded, keys, "start", "end", 0, hot_rows).select(*keys, "start", "end")
    # a zero-width sentinel at each end of the bound turns the gaps into lag pairs
    edges = bounds.select(*keys, F.explode(F.array("lo", "hi")).alias("start")).withColumn("end", F.col("start"))
    d = scan(merged.unionByName(edges), keys, ["start", "end"],
             {"_m": running_max(F.col("end"), inclusive=False)}, hot_rows)
    d = d.join(bounds, keys)
    gap = d.select(
        *keys, F.greatest(F.col("_m"), F.col("lo")).alias("start"), F.least(F.col("start"), F.col("hi")).alias("end"))
    return gap.filter((F.col("end") - F.col("start")) >= min_length)


def transitions(df: DataFrame, keys: list[str], order: list[str], actor: str, team: str,
                handoff: int, hot_rows: int | None = None) -> DataFrame:
    """WIN-05: at each change of actor: gain (first or gap beyond ``handoff``), pass (same team)
    or steal (other team)."""
    clock = order[0]
    d = scan(df, keys, order, {"_p": prev(F.struct(F.col(clock).alias("t"), F.col(actor).alias("a"),
                                                   F.col(team).alias("m")))}, hot_rows)
    gap = F.col(clock) - F.col("_p.t")
    kind = (
        F.when(F.col("_p").isNull() | (gap > handoff), "control_gain")
        .when(F.col("_p.m") == F.col(team), "pass_candidate")
        .otherwise("steal_candidate")
    )
    moved = F.col("_p").isNull() | (F.col("_p.a") != F.col(actor))
    linked = kind != "control_gain"
    return d.filter(moved).withColumn("kind", kind).select(
        *df.columns, "kind", F.when(linked, F.col("_p.a")).alias("from_actor"),
        F.when(linked, gap).alias("gap")).drop("_p")


def consecutive_distinct(df: DataFrame, keys: list[str], order: list[str], label: str,
                         hot_rows: int | None = None) -> DataFrame:
    """WIN-25: rows whose label differs from the previous row's (null-safe); first row kept."""
    d = scan(df, keys, order, {"_p": prev(F.struct(F.col(label).alias("l")))}, hot_rows)
    return d.filter(F.col("_p").isNull() | ~F.col("_p.l").eqNullSafe(F.col(label))).drop("_p")


def label_segments(df: DataFrame, keys: list[str], order: list[str], label: str, min_run: int,
                   hot_rows: int | None = None) -> DataFrame:
    """WIN-34: runs of at least ``min_run`` equal labels, merged when neighbours agree; borders
    lie midway between the last reading of one and the first of the next segment."""
    clock = order[0]
    d = island_ids(df.filter(F.col(label).isNotNull()), keys, order, F.col(label), None, "_r", hot_rows)
    runs = d.groupBy(*keys, "_r").agg(
        F.first(label).alias(label), F.min(clock).alias("t0"), F.max(clock).alias("t1"),
        F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_run)
    d = island_ids(runs, keys, ["_r"], F.col(label), None, "_s", hot_rows)
    seg = d.groupBy(*keys, "_s").agg(
        F.first(label).alias(label), F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.sum("n").alias("n"))
    seg = scan(seg, keys, ["_s"], {"_pt": prev(F.col("t1")), "_nt": next_(F.col("t0"))}, hot_rows)
    return seg.select(
        *keys, (F.col("_s") - 1).alias("segment"), label,
        F.coalesce(F.expr("(_pt + t0) div 2"), F.col("t0")).alias("start"),
        F.coalesce(F.expr("(t1 + _nt) div 2"), F.col("t1")).alias("end"), "n")


def carry_forward(df: DataFrame, keys: list[str], order: list[str], value: str, cap: int,
                  out: str, hot_rows: int | None = None) -> DataFrame:
    """WIN-14: last known value and its age in clock units over ``cap`` (1.0 at the cap or never)."""
    clock = order[0]
    box = F.when(F.col(value).isNotNull(), F.struct(F.col(clock).alias("t"), F.col(value).alias("v")))
    d = scan(df, keys, order, {"_b": fill_forward(box)}, hot_rows)
    age = F.least((F.col(clock) - F.col("_b.t")) / F.lit(float(cap)), F.lit(1.0))
    return d.select(*df.columns, F.col("_b.v").alias(out), F.coalesce(age, F.lit(1.0)).alias(f"{out}_age"))
