"""As-of and nearest joins along one clock, built as union + fill (no theta join)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtrace.operators.ordered import fill_back, fill_forward, scan


def _stack(left, right, keys, left_t, right_t, take, tie, right_side):
    lrow = left.select(
        *keys, F.col(left_t).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_left"))
    rrow = right.select(
        *keys, F.col(right_t).alias("_t"), F.lit(right_side).alias("_side"),
        *[F.col(c).alias(f"_tie{i}") for i, c in enumerate(tie)],
        F.struct(F.col(right_t).alias("_rt"), *[F.col(c).alias(a) for a, c in take.items()]).alias("_right"))
    order = ["_t", "_side", *[f"_tie{i}" for i in range(len(tie))]]
    return lrow.unionByName(rrow, allowMissingColumns=True), order


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_t: str, right_t: str,
              take: dict[str, str], direction: str = "backward", tolerance: int | None = None,
              allow_equal: bool = True, tie: tuple[str, ...] = (), hot_rows: int | None = None) -> DataFrame:
    """JOIN-03: latest right row at or before the left row (``backward``; last of ``tie`` wins)
    or earliest at or after it (``forward``; first of ``tie`` wins). Left rows are all kept."""
    if direction == "backward":
        side = 0 if allow_equal else 2
        fill = fill_forward(F.col("_right"))
    else:
        side = 2 if allow_equal else 0
        fill = fill_back(F.col("_right"))
    both, order = _stack(left, right, keys, left_t, right_t, take, tie, side)
    d = scan(both, keys, order, {"_m": fill}, hot_rows).filter("_side = 1")
    gap = F.abs(F.col("_t") - F.col("_m._rt"))
    ok = F.lit(True) if tolerance is None else gap <= tolerance
    return d.select("_left.*", *[F.when(ok, F.col(f"_m.{a}")).alias(a) for a in take])


def nearest_join(left: DataFrame, right: DataFrame, keys: list[str], left_t: str, right_t: str,
                 take: dict[str, str], tolerance: int | float | None = None,
                 hot_rows: int | None = None) -> DataFrame:
    """JOIN-02 / JOIN-14: nearest right row on either side within ``tolerance``; a tie goes to the
    earlier one. ``right`` has one row per (keys, clock); the signed offset is ``gap``."""
    both, order = _stack(left, right, keys, left_t, right_t, take, (), 0)
    d = scan(both, keys, order, {"_b": fill_forward(F.col("_right")), "_f": fill_back(F.col("_right"))},
             hot_rows).filter("_side = 1")
    back = F.col("_t") - F.col("_b._rt")
    ahead = F.col("_f._rt") - F.col("_t")
    pick = F.when(back.isNotNull() & (ahead.isNull() | (back <= ahead)), F.col("_b")).otherwise(F.col("_f"))
    d = d.withColumn("_m", pick).withColumn("gap", F.col("_m._rt") - F.col("_t"))
    ok = F.col("gap").isNotNull() if tolerance is None else F.abs("gap") <= tolerance
    return d.select("_left.*", *[F.when(ok, F.col(f"_m.{a}")).alias(a) for a in take],
                    F.when(ok, F.col("gap")).alias("gap"))


def nearest_span(points: DataFrame, spans: DataFrame, keys: list[str], t: str, start: str, end: str,
                 take: dict[str, str], slack: int, hot_rows: int | None = None) -> DataFrame:
    """JOIN-06: of the spans starting last before and first after the point, the nearer one
    (distance 0 inside) if within ``slack``; the earlier span wins a tie."""
    taken = {**take, "_end": end}
    both, order = _stack(points, spans, keys, t, start, taken, (), 0)
    d = scan(both, keys, order, {"_b": fill_forward(F.col("_right")), "_f": fill_back(F.col("_right"))},
             hot_rows).filter("_side = 1")
    back = F.greatest(F.col("_t") - F.col("_b._end"), F.lit(0))
    back = F.when(F.col("_b").isNotNull(), back)
    ahead = F.col("_f._rt") - F.col("_t")
    use_back = back.isNotNull() & (ahead.isNull() | (back <= ahead))
    dist = F.when(use_back, back).otherwise(ahead)
    pick = F.when(use_back, F.col("_b")).otherwise(F.col("_f"))
    d = d.withColumn("_m", pick).withColumn("distance", dist)
    ok = F.col("distance") <= slack
    return d.select("_left.*", *[F.when(ok, F.col(f"_m.{a}")).alias(a) for a in take],
                    F.when(ok, F.col("distance")).alias("distance"))


def pair_outcomes(df: DataFrame, keys: list[str], order: list[str], is_attempt: Column, is_outcome: Column,
                  take: dict[str, str], hot_rows: int | None = None) -> DataFrame:
    """JOIN-25: each attempt with the first outcome of the same key before the next attempt."""
    nxt = F.when(is_attempt | is_outcome, F.struct(
        is_outcome.alias("ok"), *[F.col(c).alias(a) for a, c in take.items()]))
    d = scan(df, keys, order, {"_n": fill_back(nxt, inclusive=False)}, hot_rows).filter(is_attempt)
    return d.select(*df.columns, *[F.when(F.col("_n.ok"), F.col(f"_n.{a}")).alias(a) for a in take])


def assist(controls: DataFrame, shots: DataFrame, keys: list[str], t: str, actor: str, team: str,
           max_hold: int, max_handoff: int, hot_rows: int | None = None) -> DataFrame:
    """WIN-26: the passer credited with a shot, or null.

    The last control at or before the shot must be the shooter's; the run of that control began at
    most ``max_hold`` earlier and follows a team-mate's control by at most ``max_handoff``.
    """
    from fieldtrace.operators.ordered import prev

    c = scan(controls, keys, [t], {"_p": prev(F.struct(F.col(actor).alias("a"), F.col(team).alias("m"),
                                                       F.col(t).alias("t")))}, hot_rows)
    begins = F.col("_p").isNull() | (F.col("_p.a") != F.col(actor))
    start = F.when(begins, F.struct(F.col(t).alias("t"), F.col(team).alias("m"), F.col("_p").alias("p")))
    c = scan(c, keys, [t], {"_run": fill_forward(start)}, hot_rows)
    got = asof_join(shots, c.select(*keys, t, F.col(actor).alias("_actor"), "_run"), keys, t, t,
                    {"_last": "_actor", "_run": "_run"}, hot_rows=hot_rows)
    passer = F.col("_run.p")
    ok = (
        (F.col("_last") == F.col(actor)) & (F.col(t) - F.col("_run.t") <= max_hold) & passer.isNotNull()
        & (passer["m"] == F.col("_run.m")) & (F.col("_run.t") - passer["t"] <= max_handoff)
    )
    return got.select(*shots.columns, F.when(ok, passer["a"]).alias("passer"),
                      F.when(ok, passer["t"]).alias("pass_t"))
