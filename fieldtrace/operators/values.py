"""Action values: threat grid, possession-value formula, state features and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldtrace.operators.frames import rows_frame
from fieldtrace.operators.ordered import prev, scan
from fieldtrace.session import cut_lineage

DEC = T.DecimalType(30, 12)
# Fixed values of the published formula.
SAME_PHASE_S = 10.0
PENALTY_PRIOR = 0.792453
CORNER_PRIOR = 0.046500
SHOTS = ("shot", "shot_freekick", "shot_penalty")
CORNERS = ("corner_crossed", "corner_short")


def grid_cell(x: Column, y: Column, length: float, width: float, nx: int = 16, ny: int = 12) -> Column:
    """AGG-43: cell number of a point, the far edges in the last cells."""
    cx = F.least(F.greatest(F.floor(x / length * nx), F.lit(0)), F.lit(nx - 1))
    cy = F.least(F.greatest(F.floor(y / width * ny), F.lit(0)), F.lit(ny - 1))
    return (cx * ny + cy).cast("long")


def threat_inputs(actions: DataFrame, cell: str, end_cell: str, is_shot: Column, is_goal: Column, is_move: Column,
                  moved: Column) -> tuple[DataFrame, DataFrame]:
    """AGG-43: per cell the chance to shoot and score, and to move; per cell pair the transition share.

    The tables hold at most one row per cell and per cell pair.
    """
    per = actions.groupBy(F.col(cell).alias("cell")).agg(F.count_if(is_shot).alias("shots"), F.count_if(is_shot & is_goal).alias("goals"), F.count_if(is_move).alias("moves"))
    n = F.col("shots") + F.col("moves")
    cells = per.filter(n > 0).select("cell", (F.coalesce(F.try_divide("goals", "shots"), F.lit(0.0)) * (F.col("shots") / n)).alias("gain"), (F.col("moves") / n).alias("p_move"))
    to = actions.filter(is_move & moved).groupBy(F.col(cell).alias("cell"), F.col(end_cell).alias("to")).agg(F.count(F.lit(1)).alias("_n"))
    return cells, to.join(per.select("cell", "moves"), "cell").select("cell", "to", (F.col("_n") / F.col("moves")).alias("p"))


def threat_surface(cells: DataFrame, transitions: DataFrame, tolerance: float = 1e-10, most: int = 40) -> DataFrame:
    """AGG-43: expected threat of each cell: gain now, or after any number of moves, until what is left out is below
    ``tolerance``.

    A round doubles the number of moves that are counted: the value so far, moved on by the transitions of all its
    steps, is what the next steps add. So 2^k moves take k rounds, each two joins over cell pairs with its lineage
    cut; the largest addition is the residual. Cells that never shoot and never end don't converge: an error.
    """
    value = cut_lineage(cells.select("cell", F.col("gain").alias("xt")))
    step = cut_lineage(transitions.join(cells.select("cell", "p_move"), "cell").select("cell", "to", (F.col("p") * F.col("p_move")).alias("p")))
    exact = lambda c: F.sum(c.cast(DEC)).cast("double")
    for _ in range(most):
        more = step.join(value.select(F.col("cell").alias("to"), "xt"), "to").groupBy("cell").agg(exact(F.col("p") * F.col("xt")).alias("_v"))
        both = cut_lineage(value.join(more, "cell", "left").select("cell", (F.col("xt") + F.coalesce("_v", F.lit(0.0))).alias("xt"), F.coalesce("_v", F.lit(0.0)).alias("_v")))
        value = both.select("cell", "xt")
        if (both.agg(F.max(F.abs("_v"))).first()[0] or 0.0) < tolerance:
            return value
        on = step.select(F.col("cell").alias("to"), F.col("to").alias("_to"), F.col("p").alias("_p"))
        step = cut_lineage(step.join(on, "to").groupBy("cell", F.col("_to").alias("to")).agg(exact(F.col("p") * F.col("_p")).alias("p")))
    raise ValueError(f"no convergence within 2^{most} moves")


def rate_moves(actions: DataFrame, surface: DataFrame, cell: str, end_cell: str, rated: Column) -> DataFrame:
    """AGG-43: value gained by each successful move, null for the rest. The surface has one row per cell."""
    a = surface.select(F.col("cell").alias(cell), F.col("xt").alias("_a"))
    b = surface.select(F.col("cell").alias(end_cell), F.col("xt").alias("_b"))
    d = actions.join(a, cell, "left").join(b, end_cell, "left")
    gain = F.coalesce("_b", F.lit(0.0)) - F.coalesce("_a", F.lit(0.0))
    return d.select(*actions.columns, F.when(rated, gain).alias("xt"))


def possession_values(actions: DataFrame, keys: list[str], order: list[str], hot_rows: int | None = None) -> DataFrame:
    """AGG-44: offensive, defensive and total value from the chances to score and concede.

    The previous action's chances are swapped for the other team, and void after a goal or a long
    pause; the first action is its own predecessor. Needs team_id, time_seconds, type_name, success,
    scores and concedes.
    """
    goal = F.col("type_name").isin(*SHOTS) & F.col("success")
    d = scan(actions.withColumn("_goal", goal), keys, order, {"_p": prev(F.struct("team_id", "time_seconds", "scores", "concedes", "_goal"))}, hot_rows)
    first = F.col("_p").isNull()
    same = first | (F.col("_p.team_id") == F.col("team_id"))
    void = ~first & ((F.abs(F.col("_p.time_seconds") - F.col("time_seconds")) > SAME_PHASE_S) | F.col("_p._goal"))
    ps = F.when(first, F.col("scores")).otherwise(F.col("_p.scores"))
    pc = F.when(first, F.col("concedes")).otherwise(F.col("_p.concedes"))
    void = void | (first & F.col("_goal"))
    before = F.when(void, 0.0).otherwise(F.when(same, ps).otherwise(pc))
    before = F.when(F.col("type_name") == "shot_penalty", PENALTY_PRIOR).when(F.col("type_name").isin(*CORNERS), CORNER_PRIOR).otherwise(before)
    risk = F.when(void, 0.0).otherwise(F.when(same, pc).otherwise(ps))
    off, deff = F.col("scores") - before, risk - F.col("concedes")
    return d.select(*actions.columns, off.alias("offensive_value"), deff.alias("defensive_value"), (off + deff).alias("vaep_value"))


def action_labels(actions: DataFrame, keys: list[str], order: list[str], ahead: int = 10, hot_rows: int | None = None) -> DataFrame:
    """WIN-43: does the acting team score, or concede, in this and the next ``ahead - 1`` actions of the
    game period? Own goals count for the other side. Needs team_id, goal and own_goal."""
    future = F.collect_list(F.struct("team_id", "goal", "own_goal"))
    d = rows_frame(actions, keys, order, 0, ahead - 1, {"_f": future}, hot_rows=hot_rows)
    mine = lambda a: a["team_id"] == F.col("team_id")
    scores = F.exists("_f", lambda a: (mine(a) & a["goal"]) | (~mine(a) & a["own_goal"]))
    concedes = F.exists("_f", lambda a: (~mine(a) & a["goal"]) | (mine(a) & a["own_goal"]))
    return d.select(*actions.columns, scores.alias("scores"), concedes.alias("concedes"))


def action_features(actions: DataFrame, types: list[str], results: list[str], bodyparts: list[str], length: float = 105.0,
                    width: float = 68.0) -> DataFrame:
    """WIN-43: one-hot type, result and body part, both ends in cartesian and goal-polar form, movement."""
    gx, gy = F.lit(length), F.lit(width / 2)
    c = lambda n: F.col(n).cast("double")
    one = [(F.col(col) == v).cast("double").alias(f"{p}_{v}") for col, p, vs in (
        ("type_name", "type", types), ("result_name", "result", results), ("bodypart_name", "bodypart", bodyparts)) for v in vs]

    def polar(x, y, n):
        dx, dy = F.abs(gx - x), F.abs(gy - y)
        angle = F.when(dx == 0, F.when(dy > 0, F.lit(1.5707963267948966)).otherwise(0.0)).otherwise(F.atan(dy / dx))
        return [F.sqrt(dx * dx + dy * dy).alias(f"{n}_dist_to_goal"), angle.alias(f"{n}_angle_to_goal")]

    dx, dy = c("end_x") - c("start_x"), c("end_y") - c("start_y")
    return actions.select("*", *one, *polar(c("start_x"), c("start_y"), "start"), *polar(c("end_x"), c("end_y"), "end"),
                          dx.alias("dx"), dy.alias("dy"), F.sqrt(dx * dx + dy * dy).alias("movement"))
