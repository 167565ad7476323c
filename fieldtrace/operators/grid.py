"""Fixed-grid sampling, gap filling, carry-forward features and small per-window tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtrace.operators.islands import island_ids
from fieldtrace.operators.ordered import fill_back, fill_forward, next_, prev, row_number, running_sum, scan


def grid_sample(df: DataFrame, keys: list[str], order: list[str], step: int) -> DataFrame:
    """WIN-06: first row of each (key, clock div step); an aggregate, so combined before the shuffle."""
    bucket = F.floor(F.col(order[0]) / F.lit(step)).alias("_bucket")
    row = F.struct(*df.columns)
    return df.groupBy(*keys, bucket).agg(F.min_by(row, F.struct(*order)).alias("_r")).select("_r.*")


def interpolate_gaps(df: DataFrame, keys: list[str], t: str, frame: str, coords: list[str], step: int,
                     max_gap: int, hot_rows: int | None = None) -> DataFrame:
    """WIN-08: rows every ``step`` inside gaps ``(step, max_gap]``, linear in ``coords``, flagged."""
    take = [t, frame, *coords]
    d = scan(df.select(*keys, *take), keys, [t], {"_n": next_(F.struct(*take))}, hot_rows)
    gap = F.col(f"_n.{t}") - F.col(t)
    fits = (gap > step) & (gap <= max_gap)
    d = d.withColumn("_gap", gap)
    # the last step may land exactly on the next row, which is already there
    steps = F.when(fits, F.sequence(F.lit(0), F.floor((gap - 1) / F.lit(step)).cast("int"))).otherwise(F.array(F.lit(0)))
    d = d.withColumn("_i", F.explode(steps))
    f = F.col("_i") * F.lit(float(step)) / F.col("_gap")
    filled = F.col("_i") > 0
    dframe = F.col(f"_n.{frame}") - F.col(frame)
    return d.select(
        *keys,
        F.when(filled, F.col(t) + F.floor(F.col("_gap") * f)).otherwise(F.col(t)).cast("long").alias(t),
        F.when(filled, F.col(frame) + F.rint(dframe * f).cast("long")).otherwise(F.col(frame)).cast("long").alias(frame),
        *[F.when(filled, F.col(c) + (F.col(f"_n.{c}") - F.col(c)) * f).otherwise(F.col(c).cast("double")).alias(c)
          for c in coords],
        filled.alias("interpolated"))


def linear_fill(spine: DataFrame, keys: list[str], bin_: str, value: str, hot_rows: int | None = None) -> DataFrame:
    """WIN-09: value at every spine bin between its neighbours; null outside the observed hull."""
    box = F.when(F.col(value).isNotNull(), F.struct(F.col(bin_).alias("b"), F.col(value).cast("double").alias("v")))
    d = scan(spine, keys, [bin_], {"_b": fill_forward(box), "_f": fill_back(box)}, hot_rows)
    inside = F.col("_b").isNotNull() & F.col("_f").isNotNull()
    width = F.col("_f.b") - F.col("_b.b")
    share = (F.col(bin_) - F.col("_b.b")) / width
    filled = F.when(width == 0, F.col("_b.v")).otherwise(F.col("_b.v") + (F.col("_f.v") - F.col("_b.v")) * share)
    return d.select(*spine.columns, F.when(inside, filled).alias("filled"), inside.alias("valid"))


def stitch_segments(segments: DataFrame, keys: list[str], start: str, end: str, head: Column, tail: Column,
                    max_gap: int, max_speed: float, hot_rows: int | None = None) -> DataFrame:
    """WIN-09: join a segment to the one before when the gap is short and the jump per step is slow."""
    d = segments.withColumn("_tail", F.struct(F.col(end).alias("t"), tail.alias("v")))
    d = scan(d, keys, [start], {"_p": prev(F.col("_tail"))}, hot_rows)
    gap = F.col(start) - F.col("_p.t")
    linked = (gap <= max_gap) & (F.abs(head - F.col("_p.v")) <= F.lit(float(max_speed)) * gap)
    d = d.withColumn("_o", F.when(F.coalesce(linked, F.lit(False)), 0).otherwise(1))
    return scan(d, keys, [start], {"chain": running_sum(F.col("_o"))}, hot_rows).drop("_tail", "_p", "_o")


def dense_spine(df: DataFrame, keys: list[str], bin_: str) -> DataFrame:
    """Every bin from 0 to the key's last bin (the last bin spans all channels of ``df``)."""
    top = df.groupBy(*keys).agg(F.max(bin_).alias("_top"))
    return top.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_top").cast("long"))).alias(bin_))


def pass_through(df: DataFrame, keys: list[str], t: str, above: Column, below: Column, min_rows: int = 3) -> DataFrame:
    """WIN-12: true when some row below follows a row above, false when only above, else null."""
    agg = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(F.when(above, F.col(t))).alias("_a"),
                                F.max(F.when(below, F.col(t))).alias("_b"))
    verdict = F.when((F.col("n") < min_rows) | F.col("_a").isNull(), F.lit(None)).when(F.col("_b") > F.col("_a"), True).otherwise(False)
    return agg.select(*keys, "n", verdict.cast("boolean").alias("verdict"))


def longest_segment(df: DataFrame, keys: list[str], t: str, team: str, max_gap: int,
                    hot_rows: int | None = None) -> DataFrame:
    """WIN-38: longest run of one known team; unknown rows, changes and gaps break it."""
    d = island_ids(df, keys, [t], F.col(team), max_gap, "_s", hot_rows).filter(F.col(team).isNotNull())
    seg = d.groupBy(*keys, "_s").agg(F.first(team).alias(team), F.min(t).alias("t0"), F.max(t).alias("t1"),
                                     F.count(F.lit(1)).alias("n"))
    best = seg.groupBy(*keys).agg(F.max_by(F.struct(team, "t0", "t1", "n"),
                                           F.struct(F.col("t1") - F.col("t0"), -F.col("t0"))).alias("_b"))
    return best.select(*keys, "_b.*")


def change_point(df: DataFrame, keys: list[str], t: str, side: str, sides: tuple, team: str, min_votes: int,
                 min_gain: int, hot_rows: int | None = None) -> DataFrame:
    """WIN-29: best single cut of a shot list where the side-to-team map switches (teams 0 and 1).

    A side maps to its majority team (first seen on a tie) with at least ``min_votes``; a map with
    both sides on one team explains nothing. The cut must explain ``min_gain`` more than no cut.
    """
    cells = [(i, m) for i in range(2) for m in (0, 1)]
    hit = {(i, m): ((F.col(side) == sides[i]) & (F.col(team) == m)).cast("long") for i, m in cells}
    totals = df.groupBy(*keys).agg(
        *[F.sum(hit[c]).alias(f"_t{c[0]}{c[1]}") for c in cells],
        *[F.min_by(team, F.when(F.col(side) == sides[i], F.col(t))).alias(f"_f{i}") for i in range(2)])
    ops = {f"_p{i}{m}": running_sum(hit[(i, m)]) for i, m in cells}
    for i in range(2):
        ops[f"_g{i}"] = fill_back(F.when(F.col(side) == sides[i], F.col(team)), inclusive=False)
    ops["_next"] = next_(F.col(t))
    ops["_i"] = row_number()
    d = scan(df, keys, [t], ops, hot_rows).join(totals, keys)

    def vote(a: Column, b: Column, first: Column):
        top = F.greatest(a, b)
        who = F.when(a > b, 0).when(b > a, 1).otherwise(first)
        return F.when(top >= min_votes, who), F.when(top >= min_votes, top).otherwise(0)

    def fit(cells_of, firsts):
        (m0, n0), (m1, n1) = (vote(*cells_of(i), firsts[i]) for i in range(2))
        bad = F.coalesce(m0 == m1, F.lit(False))
        return F.when(~bad, m0), F.when(~bad, m1), F.when(bad, 0).otherwise(n0 + n1)

    first = [F.col("_f0"), F.col("_f1")]
    a0, a1, n1 = fit(lambda i: (F.col(f"_p{i}0"), F.col(f"_p{i}1")), first)
    b0, b1, n2 = fit(lambda i: (F.col(f"_t{i}0") - F.col(f"_p{i}0"), F.col(f"_t{i}1") - F.col(f"_p{i}1")),
                     [F.col("_g0"), F.col("_g1")])
    _, _, nw = fit(lambda i: (F.col(f"_t{i}0"), F.col(f"_t{i}1")), first)
    switched = F.coalesce(a0 != b0, F.lit(False)) | F.coalesce(a1 != b1, F.lit(False))
    d = d.select(*keys, "_i", ((F.col(t) + F.col("_next")) / 2).alias("_mid"), F.expr(f"({t} + _next) div 2").alias("cut"),
                 n1.alias("_n1"), n2.alias("_n2"), nw.alias("whole"), switched.alias("_sw"))
    explained = F.col("_n1") + F.col("_n2")
    d = d.filter(F.col("cut").isNotNull() & (F.col("_n1") > 0) & (F.col("_n2") > 0) & F.col("_sw")
                 & (explained >= F.col("whole") + min_gain))
    best = d.groupBy(*keys).agg(F.max_by(
        F.struct(explained.alias("explained"), "whole", "cut"), F.struct(explained, -F.col("_i"))).alias("_b"))
    return best.select(*keys, "_b.*")


def smear_targets(anchors: DataFrame, keys: list[str], bin_: str, reach: int) -> DataFrame:
    """WIN-18: bins within ``reach`` of an anchor, once each."""
    return anchors.select(*keys, F.explode(F.sequence(F.col(bin_) - reach, F.col(bin_) + reach)).alias(bin_)).filter(
        F.col(bin_) >= 0).distinct()


def replay_mapping(changes: DataFrame, keys: list[str], t: str, true_id: str, observed: str, at: str,
                   hot_rows: int | None = None) -> DataFrame:
    """WIN-19: state of an event-sourced observed-to-true map at the end of each probe bin.

    ``changes`` rows say "from ``t`` on, ``true_id`` is seen as ``observed``". A change is live from
    its own bin until the next change of that true id; within a bin the last one counts, and of two
    true ids seen as the same ``observed`` the later assignment holds it.
    """
    d = changes.groupBy(*keys, true_id, at).agg(F.max_by(F.struct(t, observed), t).alias("_c"))
    d = d.select(*keys, true_id, at, "_c.*")
    d = scan(d, [*keys, true_id], [at], {"_until": next_(F.col(at))}, hot_rows)
    last = changes.groupBy(*keys).agg(F.max(at).alias("_last"))
    d = d.join(last, keys).withColumn(
        "bin", F.explode(F.sequence(F.col(at), F.coalesce(F.col("_until") - 1, F.col("_last")))))
    return d.groupBy(*keys, "bin", observed).agg(F.max_by(true_id, t).alias(true_id))


def bucket_flow(points: DataFrame, windows: DataFrame, keys: list[str], t: str, x: str, window_id: str, end: str,
                side: str, bucket: int, first: int, last: int) -> DataFrame:
    """WIN-27: drift of the mean x (exact integer sums) between ``first`` and ``last`` after a window,
    each averaged over three buckets, signed away from the attacked side."""
    cells = points.groupBy(*keys, F.floor(F.col(t) / F.lit(bucket)).alias("_b")).agg(
        F.sum(x).alias("_s"), F.count(x).alias("_n"))
    probes = windows.select(*keys, window_id, F.explode(F.array(
        F.struct(F.lit(0).alias("w"), F.floor((F.col(end) + first) / F.lit(bucket)).alias("b")),
        F.struct(F.lit(1).alias("w"), F.floor((F.col(end) + last) / F.lit(bucket)).alias("b")))).alias("_p"))
    probes = probes.select(*keys, window_id, "_p.w", F.explode(F.sequence(F.col("_p.b") - 1, F.col("_p.b") + 1)).alias("_b"))
    hit = probes.join(cells, [*keys, "_b"]).groupBy(window_id).agg(*[
        (F.sum(F.when(F.col("w") == w, F.col("_s"))) / F.sum(F.when(F.col("w") == w, F.col("_n")))).alias(f"_c{w}")
        for w in (0, 1)])
    out = windows.join(hit, window_id, "left")
    sign = F.when(F.col(side) == "right", -1.0).when(F.col(side) == "left", 1.0)
    return out.select(*windows.columns, ((F.col("_c1") - F.col("_c0")) * sign).alias("flow"))


def longest_gap(df: DataFrame, keys: list[str], t: str, lo: str, hi: str, hot_rows: int | None = None) -> DataFrame:
    """AGG-31: longest stretch without a row, counting the ones before the first and after the last."""
    d = scan(df, keys, [t], {"_p": prev(F.col(t)), "_n": next_(F.col(t))}, hot_rows)
    gap = F.greatest(F.col(t) - F.coalesce(F.col("_p"), F.col(lo)), F.when(F.col("_n").isNull(), F.col(hi) - F.col(t)))
    return d.groupBy(*keys).agg(F.max(gap).alias("longest_gap"), F.count(F.lit(1)).alias("n"))
