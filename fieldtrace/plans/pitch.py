"""Soccer plans: snapshots and labels from tracking, pass options, formations, frame audits.

Tracking is long: game, period, frame, time_s, team (0, 1, or null for the ball), player, x_m, y_m;
``direction`` has game, period, team, direction (1 or -1).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldtrace.functions import geometry as G
from fieldtrace.functions.decide import sigmoid
from fieldtrace.operators import asof
from fieldtrace.operators.metrics import quantiles
from fieldtrace.operators.ordered import prev, running_sum, scan
from fieldtrace.session import spread

L, W = G.PITCH_LENGTH, G.PITCH_WIDTH


def ball_rows(tracking: DataFrame, lookback: float = 0.6, hot_rows: int | None = None) -> DataFrame:
    """Ball per frame with the first frame at or after ``t - lookback`` and whether every frame between
    was observed (WIN-20 needs an unbroken past in one period)."""
    b = tracking.filter(F.col("team").isNull()).select("game", "period", "frame", "time_s", F.col("x_m").alias("bx"), F.col("y_m").alias("by"))
    b = b.withColumn("us", F.rint(F.col("time_s") * 1e6).cast("long"))
    gone = (F.col("bx").isNull() | F.col("by").isNull()).cast("long")
    b = scan(b.withColumn("_gone", gone), ["game"], ["us"], {"_holes": running_sum(F.col("_gone")), "_before": running_sum(F.col("_gone"), False)}, hot_rows)
    probe = b.withColumn("_t", F.col("us") - int(lookback * 1e6))
    past = b.select("game", F.col("us").alias("_pu"), F.col("bx").alias("_px"), F.col("time_s").alias("_pt"), F.col("period").alias("_pp"), F.coalesce("_before", F.lit(0)).alias("_ph"))
    d = asof.asof_join(probe, past, ["game"], "_t", "_pu", {c: c for c in ("_pu", "_px", "_pt", "_pp", "_ph")}, "forward", hot_rows=hot_rows)
    ok = (F.col("_pu") < F.col("us")) & (F.col("_pp") == F.col("period")) & (F.col("_holes") == F.col("_ph"))
    return d.select("game", "period", "frame", "time_s", "us", "bx", "by", F.when(ok, (F.col("bx") - F.col("_px")) / (F.col("time_s") - F.col("_pt"))).alias("vx"))


def snapshot_features(tracking: DataFrame, direction: DataFrame, samples: DataFrame, nx: int = 18, ny: int = 12, hot_rows: int | None = None) -> DataFrame:
    """WIN-20: 14 features of each sample (game, frame, team); null when the frame is unusable.

    The 22 players of a frame are one array, so the soft space grid is a fold inside the row.
    """
    ball = ball_rows(tracking, hot_rows=hot_rows)
    people = tracking.filter(F.col("team").isNotNull() & F.col("x_m").isNotNull() & F.col("y_m").isNotNull()).join(samples.select("game", "frame").distinct(), ["game", "frame"], "left_semi")
    arr = people.groupBy("game", "frame").agg(F.array_sort(F.collect_list(F.struct("team", F.col("x_m").cast("double").alias("x"), F.col("y_m").cast("double").alias("y")))).alias("_all"))
    d = samples.join(ball, ["game", "frame"]).join(direction, ["game", "period", "team"]).join(arr, ["game", "frame"], "left")

    def side(mine):
        picked = F.filter("_all", lambda p: (p["team"] == F.col("team")) if mine else (p["team"] != F.col("team")))
        return F.transform(picked, lambda p: F.struct(G.orient(p["x"], F.col("direction")).alias("x"), p["y"].alias("y")))

    d = d.withColumn("_us", side(True)).withColumn("_them", side(False)).withColumn("_bx", G.orient(F.col("bx"), F.col("direction")))
    d = d.withColumn("_by", F.col("by"))
    ok = (F.size("_us") >= 7) & (F.size("_them") >= 7) & F.col("_bx").between(0, L) & F.col("_by").between(0, W) & F.col("vx").isNotNull()

    def quantile(a, axis, q):
        s = F.array_sort(F.transform(a, lambda p: p[axis]))
        pos = F.lit(q) * (F.size(a) - 1)
        lo, hi = F.get(s, F.floor(pos).cast("int")), F.get(s, F.ceil(pos).cast("int"))
        return lo + (hi - lo) * (pos - F.floor(pos))

    def spread(a, axis):
        return quantile(a, axis, 0.9) - quantile(a, axis, 0.1)

    def nearest(a, x, y):
        return F.array_min(F.transform(a, lambda p: G.dist(p["x"], p["y"], x, y)))

    def mean(a, axis):
        return F.aggregate(a, F.lit(0.0), lambda s, p: s + p[axis]) / F.size(a)

    xs = [L * i / (nx - 1) for i in range(nx) if L * i / (nx - 1) >= 70.0]
    ys = [W * j / (ny - 1) for j in range(ny)]
    cells = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in xs for y in ys])
    share = F.aggregate(cells, F.lit(0.0), lambda s, c: s + sigmoid((nearest(F.col("_them"), c["x"], c["y"]) - nearest(F.col("_us"), c["x"], c["y"])) / 3.0)) / (len(xs) * len(ys))
    bx, by = F.col("_bx"), F.col("_by")
    out = {
        "ball_progress_m": bx, "ball_distance_touchline_m": F.least(by, F.lit(W) - by),
        "ball_forward_speed_mps": F.greatest(F.lit(-40.0), F.least(F.lit(40.0), F.col("vx") * F.col("direction"))),
        "team_width_m": spread(F.col("_us"), "y"), "team_depth_m": spread(F.col("_us"), "x"), "opponent_width_m": spread(F.col("_them"), "y"), "opponent_depth_m": spread(F.col("_them"), "x"),
        "nearest_opponent_m": nearest(F.col("_them"), bx, by), "teammates_ahead": F.size(F.filter("_us", lambda p: p["x"] > bx)), "opponents_ahead": F.size(F.filter("_them", lambda p: p["x"] > bx)),
        "team_center_to_ball_m": G.dist(mean(F.col("_us"), "x"), mean(F.col("_us"), "y"), bx, by), "advanced_space_share": share,
        "observed_teammates": F.size("_us"), "observed_opponents": F.size("_them"),
    }
    return d.select(*samples.columns, "period", "time_s", ok.alias("usable"), *[F.when(ok, c).alias(n) for n, c in out.items()])


FEATURES = ["ball_progress_m", "ball_distance_touchline_m", "ball_forward_speed_mps", "team_width_m", "team_depth_m", "opponent_width_m", "opponent_depth_m",
            "nearest_opponent_m", "teammates_ahead", "opponents_ahead", "team_center_to_ball_m", "advanced_space_share", "observed_teammates", "observed_opponents"]


def forward_target(tracking: DataFrame, direction: DataFrame, samples: DataFrame, horizon: float = 5.0, gain: float = 10.0, min_seen: float = 0.9) -> DataFrame:
    """WIN-21: 1 when the ball advances ``gain`` within ``horizon`` (inclusive) before the possession's
    ``end_s`` (exclusive); null without a ball, a future, or ``min_seen`` of it observed."""
    from fieldtrace.operators.interval import span_pairs

    b = tracking.filter(F.col("team").isNull()).select("game", "period", "frame", F.rint(F.col("time_s") * 1e6).cast("long").alias("_fu"), F.col("x_m").alias("_fx"), F.col("y_m").alias("_fy"))
    s = samples.join(b.select("game", "frame", "period", F.col("_fu").alias("_u"), F.col("_fx").alias("_x"), F.col("_fy").alias("_y")), ["game", "frame"]).join(direction, ["game", "period", "team"])
    h = int(horizon * 1e6)
    spans = s.select("game", F.col("frame").alias("_at"), "team", "direction", "_x", "_y", "end_s", "_u", (F.col("_u") + h).alias("_hi"))
    pairs = span_pairs(b.select("game", "_fu", "_fx", "_fy"), spans, ["game"], "_fu", "_u", "_hi", h, "right", max_length=h)
    pairs = pairs.filter(F.col("_fu") < F.rint(F.col("end_s") * 1e6))
    g = pairs.groupBy("game", "_at", "team").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("_fx").isNotNull() & F.col("_fy").isNotNull()).alias("_seen"), F.max((F.col("_fx") - F.col("_x")) * F.col("direction")).alias("_gain"),
        F.max(F.col("_x").isNotNull() & F.col("_y").isNotNull()).alias("_here"))
    ok = F.col("_here") & (F.col("_seen") / F.col("_n") >= min_seen)
    g = g.select("game", F.col("_at").alias("frame"), "team", F.when(ok, (F.col("_gain") >= gain).cast("int")).alias("advances"))
    return samples.join(g, ["game", "frame", "team"], "left")


def sample_grid(possessions: DataFrame, frames_: DataFrame, step: float = 5.0, lead: float = 1.0, after_period: float = 5.0) -> DataFrame:
    """Sampling instants of each possession every ``step`` seconds, moved to the first frame at or after them."""
    start = frames_.groupBy("game", "period").agg(F.min("time_s").alias("_p0"))
    p = possessions.join(start, ["game", "period"])
    first = F.greatest(F.col("start") + lead, F.col("_p0") + after_period)
    n = F.ceil((F.col("end") - 1.0 - first) / step).cast("int")
    p = p.filter(n > 0).withColumn("_i", F.explode(F.sequence(F.lit(0), n - 1))).withColumn("_want", F.rint((first + F.col("_i") * step) * 1e6).cast("long"))
    f = frames_.select("game", F.rint(F.col("time_s") * 1e6).cast("long").alias("_fu"), F.col("frame").alias("_frame"))
    d = asof.asof_join(p, f, ["game"], "_want", "_fu", {"frame": "_frame", "_fu": "_fu"}, "forward")
    return d.filter(F.col("_fu") < F.rint(F.col("end") * 1e6)).drop("_p0", "_i", "_want", "_fu")


def direction_by_period(tracking: DataFrame, opening_s: float = 5.0) -> DataFrame:
    """SRC-06: attack direction per period from the median x of both teams in the opening seconds; a
    difference below 1 m is an error."""
    t0 = tracking.groupBy("game", "period").agg(F.min("time_s").alias("_t0"))
    d = tracking.join(t0, ["game", "period"]).filter(F.col("team").isNotNull() & (F.col("time_s") < F.col("_t0") + opening_s))
    q = quantiles(d, ["game", "period", "team"], "x_m", {"m": (0.5, "linear")})
    g = q.groupBy("game", "period").agg(F.max(F.when(F.col("team") == 0, F.col("m"))).alias("_h"), F.max(F.when(F.col("team") == 1, F.col("m"))).alias("_a"))
    clear = F.when(F.abs(F.col("_h") - F.col("_a")) >= 1.0, F.when(F.col("_h") < F.col("_a"), 1).otherwise(-1)).otherwise(F.raise_error(F.lit("direction: opening positions do not tell the sides apart")).cast("int"))
    return g.select("game", "period", F.explode(F.array(F.struct(F.lit(0).alias("team"), clear.alias("direction")), F.struct(F.lit(1).alias("team"), (-clear).alias("direction")))).alias("_x")).select("game", "period", "_x.*")


def pass_options(events: DataFrame, tracking: DataFrame, direction: DataFrame, min_players: int = 7, hot_rows: int | None = None) -> DataFrame:
    """JOIN-32: visible team-mates of the passer with pass geometry at the last frame of the event's
    period before the event; ``events``: game, event_id, period, time_s, team, passer, receiver."""
    f = tracking.filter(F.col("team").isNull()).select("game", "period", "frame", F.rint(F.col("time_s") * 1e6).cast("long").alias("_fu"), F.col("x_m").alias("_bx"), F.col("y_m").alias("_by"))
    e = events.withColumn("_u", F.rint(F.col("time_s") * 1e6).cast("long"))
    e = asof.asof_join(e, f, ["game", "period"], "_u", "_fu", {"frame": "frame", "_bx": "_bx", "_by": "_by"}, hot_rows=hot_rows).filter(F.col("_bx").isNotNull() & F.col("_by").isNotNull())
    e = e.join(direction, ["game", "period", "team"])
    seen = tracking.filter(F.col("team").isNotNull() & F.col("x_m").isNotNull() & F.col("y_m").isNotNull()).select("game", "frame", F.col("team").alias("_team"), "player", F.col("x_m").cast("double").alias("_x"), F.col("y_m").cast("double").alias("_y"))
    arr = seen.groupBy("game", "frame").agg(F.array_sort(F.collect_list(F.struct("_team", "player", "_x", "_y"))).alias("_all"))
    d = spread(e.join(arr, ["game", "frame"]), ["game", "event_id"])
    flip = lambda p: F.struct(p["player"].alias("player"), G.orient(p["_x"], F.col("direction")).alias("x"), p["_y"].alias("y"))
    d = d.withColumn("_own", F.transform(F.filter("_all", lambda p: p["_team"] == F.col("team")), flip)).withColumn("_opp", F.transform(F.filter("_all", lambda p: p["_team"] != F.col("team")), flip))
    d = d.filter((F.size("_own") >= min_players) & (F.size("_opp") >= min_players) & (F.size("_opp") > 0))
    d = d.filter(F.exists("_own", lambda p: p["player"] == F.col("receiver"))).withColumn("_bx", G.orient(F.col("_bx"), F.col("direction")).cast("double")).withColumn("_by", F.col("_by").cast("double"))
    d = d.withColumn("_near", _nearest_opponents("_bx", "_by", "_own.x", "_own.y", "_opp.x", "_opp.y"))
    d = d.select("game", "event_id", "frame", "passer", "receiver", "_bx", "_by", F.col("_near.passer").alias("_pressure"),
                 F.explode(F.arrays_zip(F.col("_own.player").alias("player"), F.col("_own.x").alias("x"), F.col("_own.y").alias("y"), F.col("_near.lane").alias("lane"), F.col("_near.receiver").alias("near"))).alias("_r"))
    length = G.dist(F.col("_r.x"), F.col("_r.y"), F.col("_bx"), F.col("_by"))
    d = d.filter(F.col("_r.player") != F.col("passer")).filter(length >= 1)
    return d.select("game", "event_id", "frame", F.col("_r.player").alias("option"), (F.col("_r.player") == F.col("receiver")).alias("chosen"), length.alias("length"), (F.col("_r.x") - F.col("_bx")).alias("forward"),
                    F.abs(F.col("_r.y") - F.col("_by")).alias("lateral"), F.col("_r.lane").alias("lane_clearance"), F.col("_r.near").alias("receiver_pressure"), F.col("_pressure").alias("passer_pressure"), F.col("_r.x").alias("receiver_x"))


@F.pandas_udf(T.StructType([T.StructField("lane", T.ArrayType(T.DoubleType())), T.StructField("receiver", T.ArrayType(T.DoubleType())), T.StructField("passer", T.DoubleType())]))
def _nearest_opponents(bx: pd.Series, by: pd.Series, rx: pd.Series, ry: pd.Series, ox: pd.Series, oy: pd.Series) -> pd.DataFrame:
    """FN-19 for all receivers of a frame: the least distance of an opponent from the pass, the receiver and the ball.

    Players at one point share their distances; receivers meet opponents in blocks.
    """
    import numpy as np

    lane, receiver, passer = [], [], []
    for x, y, *arrays in zip(bx, by, rx, ry, ox, oy, strict=True):
        own, back = np.unique(np.column_stack(arrays[:2]), axis=0, return_inverse=True)
        u, v = np.unique(np.column_stack(arrays[2:]), axis=0).T
        free, close = np.empty(len(own)), np.empty(len(own))
        step = max(1, 250_000 // len(u))
        with np.errstate(all="ignore"):  # a pass of no length is left out behind
            for i in range(0, len(own), step):
                px, py = own[i:i + step, :1], own[i:i + step, 1:]
                dx, dy = px - x, py - y
                s = np.maximum(0.0, np.minimum(1.0, ((u - x) * dx + (v - y) * dy) / (dx * dx + dy * dy)))
                ax, ay = u - (x + s * dx), v - (y + s * dy)
                free[i:i + step] = np.fmin.reduce(np.sqrt(ax * ax + ay * ay), axis=1)
                ax, ay = u - px, v - py
                close[i:i + step] = np.fmin.reduce(np.sqrt(ax * ax + ay * ay), axis=1)
            passer.append(np.fmin.reduce(np.sqrt((u - x) * (u - x) + (v - y) * (v - y))))
        back = back.reshape(-1)
        lane.append(free[back])
        receiver.append(close[back])
    return pd.DataFrame({"lane": lane, "receiver": receiver, "passer": passer})


def goalkeeper_proxies(obs: DataFrame, min_coverage: float = 0.8, min_gap: float = 3.0, hot_rows: int | None = None) -> DataFrame:
    """AGG-42: per period and team the well-covered player with the least median distance to a goal.

    ``obs``: game, period, frame, team, player, x_m, y_m (observed rows). ``status`` is ok, none (nobody
    covered enough), ambiguous (the next player at that goal is nearer than ``min_gap``) or same_goal.
    """
    total = obs.groupBy("game", "period").agg(F.count_distinct("frame").alias("_frames"))
    per = obs.groupBy("game", "period", "team", "player").agg(F.count_distinct("frame").alias("_n"))
    good = per.join(total, ["game", "period"]).filter(F.col("_n") / F.col("_frames") >= min_coverage).select("game", "period", "team", "player")
    d = obs.join(good, ["game", "period", "team", "player"]).withColumn("goal_x", F.explode(F.array(F.lit(0.0), F.lit(L))))
    d = d.withColumn("_d", G.dist(F.col("x_m"), F.col("y_m"), F.col("goal_x"), F.lit(W / 2)))
    key = ["game", "period", "team"]
    med = quantiles(d, [*key, "player", "goal_x"], "_d", {"median": (0.5, "linear")}, hot_rows).drop("n")
    best = med.groupBy(*key).agg(F.min_by(F.struct("player", "goal_x", "median"), F.struct("median", "player", "goal_x")).alias("_b")).select(*key, "_b.*")
    rival = med.join(best.select(*key, F.col("player").alias("_p"), "goal_x"), [*key, "goal_x"]).filter(F.col("player") != F.col("_p")).groupBy(*key).agg(F.min("median").alias("_rival"))
    d = best.join(rival, key, "left").withColumn("gap", F.col("_rival") - F.col("median"))
    same = d.groupBy("game", "period").agg((F.count_distinct("goal_x") < F.count(F.lit(1))).alias("_same"))
    status = F.when(F.col("gap").isNull() | (F.col("gap") < min_gap), "ambiguous").when(F.col("_same"), "same_goal").otherwise("ok")
    return d.join(same, ["game", "period"]).select(*key, "player", "goal_x", "median", "gap", F.when(F.col("goal_x") == 0, 1).otherwise(-1).alias("direction"), status.alias("status"))


def eligible_frames(obs: DataFrame, keepers: DataFrame, owners: DataFrame, players: int = 11) -> DataFrame:
    """WIN-39: every frame with the reasons it is left out, joined by ";".

    ``obs``: game, period, frame, entity (player or ball), team, player, status, x_m, y_m; ``owners``: game,
    period, frame, owner (null when no interval covers the frame).
    """
    k = keepers.select("game", "period", "team", F.col("player").alias("_keeper"))
    seen = F.col("status") == "observed"
    d = obs.join(k, ["game", "period", "team"], "left")
    bad = F.col("x_m").isNull() | F.col("y_m").isNull() | F.isnan("x_m") | F.isnan("y_m")
    out = (F.col("x_m") < 0) | (F.col("x_m") > L) | (F.col("y_m") < 0) | (F.col("y_m") > W)
    aggs = []
    for m, name in ((0, "home"), (1, "away")):
        mine = seen & (F.col("team") == m)
        aggs += [F.count_if(mine).alias(f"{name}_observed"), F.count_if(mine & (F.col("player") == F.col("_keeper"))).alias(f"_{name}_k"),
                 F.count_if(mine & bad).alias(f"_{name}_bad"), F.count_if(mine & ~bad & out).alias(f"_{name}_out")]
    ball = seen & (F.col("entity") == "ball")
    aggs += [F.count_if(ball).alias("_balls"), F.count_if(ball & bad).alias("_ball_bad")]
    g = d.groupBy("game", "period", "frame").agg(*aggs).join(owners, ["game", "period", "frame"], "left")
    reasons = []
    for name in ("home", "away"):
        reasons += [F.when(~((F.col(f"{name}_observed") == players) & (F.col(f"_{name}_k") > 0)), f"{name}_incomplete_11_with_keeper_proxy"),
                    F.when(F.col(f"_{name}_bad") > 0, f"{name}_nonfinite_coordinates").when(F.col(f"_{name}_out") > 0, f"{name}_outside_pitch_coordinates")]
    reasons += [F.when((F.col("_balls") != 1) | (F.col("_ball_bad") > 0), "ball_unavailable"), F.when(F.col("owner").isNull(), "provider_event_possession_unavailable")]
    text = F.concat_ws(";", *reasons)
    return g.select("game", "period", "frame", "home_observed", "away_observed", "owner", (text == "").alias("eligible"), text.alias("omitted_reasons"))


def shape_stability(shapes: DataFrame, keys: list[str], t: str, label: str, phase: str, step: int, hot_rows: int | None = None) -> DataFrame:
    """AGG-41: dominant label and its share, and how often the label changes between rows exactly
    ``step`` apart in the same phase."""
    d = scan(shapes, keys, [t], {"_p": prev(F.struct(t, label, phase))}, hot_rows)
    near = F.coalesce((F.col(t) - F.col(f"_p.{t}") == step) & (F.col(phase) == F.col(f"_p.{phase}")), F.lit(False))
    moved = near & (F.col(label) != F.col(f"_p.{label}"))
    g = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("frames"), F.count_if(near).alias("pairs"), F.count_if(moved).alias("changed"))
    top = shapes.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("_n")).groupBy(*keys).agg(F.min_by(F.struct(label, "_n"), F.struct(-F.col("_n"), F.col(label))).alias("_b"))
    return g.join(top, keys).select(*keys, "frames", F.col(f"_b.{label}").alias("dominant"), (F.col("_b._n") / F.col("frames")).alias("dominant_share"), "pairs", "changed",
                                    F.try_divide(F.col("pairs") - F.col("changed"), F.col("pairs")).alias("stability"))


def _even(n: int) -> list[float]:
    return [i / (n - 1) for i in range(n)]


# Lines of each shape from defence to attack as (depth, widths).
SHAPES = {
    "4-3-3": [(0.0, _even(4)), (0.5, [0.15, 0.5, 0.85]), (1.0, [0.1, 0.5, 0.9])],
    "4-4-2": [(0.0, _even(4)), (0.5, _even(4)), (1.0, [0.3, 0.7])],
    "4-2-3-1": [(0.0, _even(4)), (0.35, [0.3, 0.7]), (0.7, [0.1, 0.5, 0.9]), (1.0, [0.5])],
}


def formation(players: DataFrame, keys: list[str]) -> DataFrame:
    """ML-07: nearest shape of eleven placed players, its mean distance, and the role of each: the deepest is left out as
    keeper, the others take the slots of the shape that cost least in total. Geometry, not a claim about roles.

    ``players``: keys, player, x, y in attack direction. A side of one frame is one small array; a batch of sides is
    normalised and priced together. Any other number of players with a position gives "unknown".
    """
    placed = F.coalesce(~F.isnan("x") & ~F.isnan("y") & (F.abs("x") < float("inf")) & (F.abs("y") < float("inf")), F.lit(False))
    d = players.select(*keys, "player", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    g = d.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(placed, F.struct("x", "y", "player")))).alias("_p"))

    @F.pandas_udf("struct<shape:string,error:double,slots:array<int>>")
    def fit(batch: pd.Series) -> pd.DataFrame:
        import numpy as np

        from fieldtrace.operators.kernels import assign

        out = pd.DataFrame({"shape": "unknown", "error": None, "slots": None}, index=range(len(batch)), dtype=object)
        full = [i for i, side in enumerate(batch) if len(side) == 11]
        if not full:
            return out
        spots = np.array([[(p["x"], p["y"]) for p in batch.iloc[i]] for i in full])[:, 1:]  # in order of depth, without the deepest
        low, high = spots.min(axis=1, keepdims=True), spots.max(axis=1, keepdims=True)
        spots = (spots - low) / np.maximum(high - low, 1)
        best = [(np.inf, "", ())] * len(full)
        for name, lines in SHAPES.items():
            slots = np.array([(depth, width) for depth, widths in lines for width in widths])
            price = np.hypot(spots[:, :, None, 0] - slots[:, 0], spots[:, :, None, 1] - slots[:, 1])
            for k, cost in enumerate(price):
                taken = assign(cost)
                mean = sum(cost[p, s] for p, s in taken) / len(taken)
                if mean < best[k][0]:
                    best[k] = (mean, name, [s for _, s in sorted(taken)])
        for i, (mean, name, taken) in zip(full, best, strict=True):
            out.loc[i, "shape"], out.loc[i, "error"] = name, float(mean)
            out.at[i, "slots"] = [-1, *map(int, taken)]
        return out

    role = lambda p, i: F.struct(p["player"].alias("player"), F.when(i == 0, "deepest_player_proxy").otherwise(
        F.concat(F.col("_f.shape"), F.lit(":slot-"), (F.get("_f.slots", i) + 1).cast("string"))).alias("role"))
    named = F.when(F.col("_f.slots").isNotNull(), F.transform("_p", role)).otherwise(F.array().cast(f"array<struct<player:{players.schema['player'].dataType.simpleString()},role:string>>"))
    return g.withColumn("_f", fit("_p")).select(*keys, "_f.shape", "_f.error", named.alias("roles"))


def orientation_audit(tracking: DataFrame, frames_: DataFrame) -> DataFrame:
    """WIN-46: features of each frame for both teams under both attack directions, one row each."""
    both = frames_.select("game", "frame", "period", F.explode(F.array(*[
        F.struct(F.lit(t).alias("team"), F.lit(d).alias("direction")) for t in (0, 1) for d in (1, -1)])).alias("_x")).select("game", "frame", "period", "_x.*")
    out = None
    for d in (1, -1):
        part = both.filter(F.col("direction") == d)
        got = snapshot_features(tracking, part.select("game", "period", "team", "direction").distinct(), part.select("game", "frame", "team")).withColumn("direction", F.lit(d))
        out = got if out is None else out.unionByName(got)
    return out
