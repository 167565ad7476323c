"""Tracking snapshots, formations and action values over event-shaped rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtrace.operators import values
from fieldtrace.plans import pitch
from fieldtrace.plans.registry import DAY, EV, HOUR, Tables, query


@query("win38_phase_seconds", f"""WITH {EV}, d AS (SELECT user_id, event_type, lead(us) OVER (PARTITION BY user_id ORDER BY us) - us AS dur FROM ev)
SELECT user_id, event_type, CAST(sum(dur) AS BIGINT) AS total_us, count(dur) AS n FROM d GROUP BY 1, 2""")
def _(t: Tables):
    from fieldtrace.operators.ordered import next_, scan
    d = scan(t.ev, ["user_id"], ["us"], {"_n": next_(F.col("us"))}).withColumn("dur", F.col("_n") - F.col("us"))
    return d.groupBy("user_id", "event_type").agg(F.sum("dur").alias("total_us"), F.count("dur").alias("n"))


def track(t: Tables):
    """Long tracking: game = user mod 30, frame = half day, events are players, clicks the ball."""
    base = t.ev.select((F.col("user_id") % 30).cast("int").alias("game"), F.floor(F.col("us") / F.lit(12 * HOUR)).alias("frame"), "us", "event_type", (F.col("k") * 1.05).alias("x_m"),
                       ((F.col("cents") % 68)).cast("double").alias("y_m"), F.col("event_id").cast("string").alias("player"), (F.col("k") % 2).cast("int").alias("team"))
    people = base.filter("event_type <> 'click'")
    ball = base.filter("event_type = 'click'").groupBy("game", "frame").agg(F.min_by(F.struct("x_m", "y_m"), "us").alias("b"))
    time = (F.col("frame") * 0.6).alias("time_s")
    one = F.lit(1).alias("period")
    return people.select("game", one, "frame", time, "team", "player", "x_m", "y_m").unionByName(
        ball.select("game", one, "frame", time, F.lit(None).cast("int").alias("team"), F.lit("ball").alias("player"), "b.x_m", "b.y_m"))


TRK = f"""{EV}, base AS (SELECT (user_id % 30)::INTEGER AS game, us // {12 * HOUR} AS frame, us, event_type, k * 1.05::DOUBLE AS x, (cents % 68)::DOUBLE AS y, (k % 2)::INTEGER AS team FROM ev),
pl AS (SELECT * FROM base WHERE event_type <> 'click'), ba AS (SELECT game, frame, arg_min(x, us) AS bx, arg_min(y, us) AS byy FROM base WHERE event_type = 'click' GROUP BY 1, 2)"""


@query("win20_snapshots", f"""WITH {TRK}, prv AS (SELECT game, frame, bx, byy, lag(bx) OVER w AS px, lag(frame) OVER w AS pf FROM ba WINDOW w AS (PARTITION BY game ORDER BY frame)),
s AS (SELECT game, frame, bx, byy, (bx - px) / (frame * 0.6::DOUBLE - pf * 0.6::DOUBLE) AS vx FROM prv WHERE pf = frame - 1),
u AS (SELECT s.*, (SELECT list(x ORDER BY x) FROM pl WHERE pl.game=s.game AND pl.frame=s.frame AND team=0) AS ux, (SELECT list(y ORDER BY y) FROM pl WHERE pl.game=s.game AND pl.frame=s.frame AND team=0) AS uy,
  (SELECT list(x) FROM pl WHERE pl.game=s.game AND pl.frame=s.frame AND team=1) AS ox,
  (SELECT min(sqrt((x-bx)*(x-bx)+(y-byy)*(y-byy))) FROM pl WHERE pl.game=s.game AND pl.frame=s.frame AND team=1) AS near FROM s)
SELECT game, frame, bx AS ball_progress_m, least(byy, 68.0::DOUBLE - byy) AS ball_distance_touchline_m, greatest(-40.0::DOUBLE, least(40.0::DOUBLE, vx)) AS ball_forward_speed_mps, near AS nearest_opponent_m,
  len(list_filter(ux, lambda v: v > bx)) AS teammates_ahead, len(list_filter(ox, lambda v: v > bx)) AS opponents_ahead, len(ux) AS observed_teammates, len(ox) AS observed_opponents FROM u WHERE len(ux) >= 7 AND len(ox) >= 7 AND bx <= 105""")
def _(t: Tables):
    """Team 0 snapshots of every frame with a ball; a frame is half a day, so its past is the frame before."""
    tr = track(t)
    direction = tr.select("game", "period").distinct().withColumn("team", F.lit(0)).withColumn("direction", F.lit(1))
    samples = tr.filter("team is null").select("game", "frame", F.lit(0).alias("team"))
    d = pitch.snapshot_features(tr, direction, samples).filter("usable")
    return d.select("game", "frame", "ball_progress_m", "ball_distance_touchline_m", "ball_forward_speed_mps", "nearest_opponent_m",
                    *[F.col(c).cast("long").alias(c) for c in ("teammates_ahead", "opponents_ahead", "observed_teammates", "observed_opponents")])


@query("win21_forward_target")
def _(t: Tables):
    tr = track(t)
    direction = tr.select("game", "period").distinct().withColumn("team", F.lit(0)).withColumn("direction", F.lit(1))
    samples = tr.filter("team is null").select("game", "frame", F.lit(0).alias("team"), (F.col("time_s") + 100.0).alias("end_s"))
    return pitch.forward_target(tr, direction, samples)


@query("win46_orientation_audit")
def _(t: Tables):
    tr = track(t)
    return pitch.orientation_audit(tr, tr.filter("team is null").select("game", "frame", "period"))


@query("join32_pass_options")
def _(t: Tables):
    """Team-mates in view of each view event's frame with pass geometry (game and frame as in the snapshots)."""
    tr = track(t)
    both = F.explode(F.array(*[F.struct(F.lit(m).alias("team"), F.lit(d).alias("direction")) for m, d in ((0, 1), (1, -1))]))
    direction = tr.select("game", "period").distinct().select("game", "period", both.alias("_x")).select("game", "period", "_x.*")
    passer = tr.filter("team is not null").groupBy("game", "period", "frame", "time_s", "team").agg(F.min("player").alias("passer"), F.max("player").alias("receiver"))
    e = passer.withColumn("event_id", F.concat_ws("-", "game", "frame", "team")).drop("frame")
    return pitch.pass_options(e, tr, direction, min_players=2).drop("frame")


@query("agg41_shape_stability", f"""WITH {EV}, s AS (SELECT user_id % 30 AS game, us // {6 * HOUR} AS f, arg_max(event_type, us) AS shape, max(k) % 2 AS phase FROM ev GROUP BY 1, 2),
p AS (SELECT *, lag(f) OVER w AS pf, lag(shape) OVER w AS ps, lag(phase) OVER w AS pp FROM s WINDOW w AS (PARTITION BY game ORDER BY f)),
g AS (SELECT game, count(*) AS frames, count_if(f - pf = 1 AND phase = pp) AS pairs, count_if(f - pf = 1 AND phase = pp AND shape <> ps) AS changed FROM p GROUP BY 1),
c AS (SELECT game, shape, count(*) AS n FROM s GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY game ORDER BY count(*) DESC, shape) = 1)
SELECT game, frames, shape AS dominant, n / frames AS dominant_share, pairs, changed, CASE WHEN pairs > 0 THEN (pairs - changed) / pairs END AS stability FROM g JOIN c USING (game)""")
def _(t: Tables):
    s = t.ev.groupBy((F.col("user_id") % 30).alias("game"), F.floor(F.col("us") / F.lit(6 * HOUR)).alias("f")).agg(F.max_by("event_type", "us").alias("shape"), (F.max("k") % 2).alias("phase"))
    return pitch.shape_stability(s, ["game"], "f", "shape", "phase", 1)


@query("agg42_keeper_proxies", f"""WITH {EV}, o AS (SELECT user_id % 10 AS game, 1 AS period, us // {DAY} AS frame, k % 2 AS team, k % 10 AS player, k * 1.05::DOUBLE AS x, (cents % 68)::DOUBLE AS y FROM ev),
tt AS (SELECT game, count(DISTINCT frame) AS fr FROM o GROUP BY 1), gd AS (SELECT game, team, player FROM o JOIN tt USING (game) GROUP BY game, team, player, fr HAVING count(DISTINCT frame) / fr >= 0.8),
m AS (SELECT game, team, player, gx, quantile_cont(sqrt((x-gx)*(x-gx)+(y-34.0::DOUBLE)*(y-34.0::DOUBLE)), 0.5) AS md FROM o JOIN gd USING (game, team, player), (SELECT unnest([0.0::DOUBLE, 105.0::DOUBLE]) AS gx) GROUP BY 1, 2, 3, 4),
b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY game, team ORDER BY md, player, gx) = 1),
r AS (SELECT b.game, b.team, min(m.md) AS rv FROM b JOIN m ON m.game=b.game AND m.team=b.team AND m.gx=b.gx AND m.player<>b.player GROUP BY 1, 2),
s AS (SELECT game, count(DISTINCT gx) < count(*) AS same FROM b GROUP BY 1)
SELECT b.game, b.team, b.player, CASE WHEN rv IS NULL OR rv - md < 3.0 THEN 'ambiguous' WHEN same THEN 'same_goal' ELSE 'ok' END AS status FROM b LEFT JOIN r ON r.game=b.game AND r.team=b.team JOIN s ON s.game=b.game""")
def _(t: Tables):
    o = t.ev.select((F.col("user_id") % 10).alias("game"), F.lit(1).alias("period"), F.floor(F.col("us") / F.lit(DAY)).alias("frame"), (F.col("k") % 2).alias("team"), (F.col("k") % 10).alias("player"),
                    (F.col("k") * 1.05).alias("x_m"), (F.col("cents") % 68).cast("double").alias("y_m"))
    return pitch.goalkeeper_proxies(o).select("game", "team", "player", "status")


@query("win39_eligible_frames", f"""WITH {EV}, o AS (SELECT user_id % 30 AS game, us // {12 * HOUR} AS frame, event_type, k % 2 AS team, k AS player, k * 1.1::DOUBLE AS x FROM ev),
g AS (SELECT game, frame, count_if(event_type <> 'click' AND team=0) AS h, count_if(event_type <> 'click' AND team=1) AS a, count_if(event_type <> 'click' AND team=0 AND x > 105) AS ho, count_if(event_type <> 'click' AND team=1 AND x > 105) AS ao, count_if(event_type='click') AS b FROM o GROUP BY 1, 2)
SELECT game, frame, concat_ws(';', CASE WHEN h <> 2 THEN 'home_incomplete_11_with_keeper_proxy' END, CASE WHEN ho > 0 THEN 'home_outside_pitch_coordinates' END, CASE WHEN a <> 2 THEN 'away_incomplete_11_with_keeper_proxy' END, CASE WHEN ao > 0 THEN 'away_outside_pitch_coordinates' END,
  CASE WHEN b <> 1 THEN 'ball_unavailable' END, CASE WHEN frame % 3 = 0 THEN 'provider_event_possession_unavailable' END) AS omitted_reasons FROM g""")
def _(t: Tables):
    """Two players a side stand in for eleven; every player counts as the keeper here."""
    e = t.ev.select((F.col("user_id") % 30).alias("game"), F.lit(1).alias("period"), F.floor(F.col("us") / F.lit(12 * HOUR)).alias("frame"), F.when(F.col("event_type") == "click", "ball").otherwise("player").alias("entity"),
                    F.when(F.col("event_type") != "click", (F.col("k") % 2).cast("int")).alias("team"), F.lit("any").alias("player"), F.lit("observed").alias("status"), (F.col("k") * 1.1).alias("x_m"), F.lit(10.0).alias("y_m"))
    keepers = e.filter("team is not null").select("game", "period", "team", "player").distinct()
    owners = e.select("game", "period", "frame").distinct().withColumn("owner", F.when(F.col("frame") % 3 != 0, 0))
    return pitch.eligible_frames(e, keepers, owners, players=2).select("game", "frame", "omitted_reasons")


@query("ml07_formations")
def _(t: Tables):
    """Nearest formation of eleven events of each user (assignment kernel is unit-tested)."""
    from fieldtrace.operators.ordered import row_number, scan
    d = scan(t.ev, ["user_id"], ["us"], {"_rn": row_number()})
    d = d.select("user_id", F.floor((F.col("_rn") - 1) / 11).alias("frame"), F.col("event_id").alias("player"), (F.col("k") * 1.05).alias("x"), (F.col("cents") % 68).alias("y"))
    return pitch.formation(d, ["user_id", "frame"])


# Action rows: cells are event type x k decade, a purchase shoots, everything else moves to the next event.
CELL = "CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'error' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END * 5 + least(k // 20, 4)"
ACT = f"""{EV}, a0 AS (SELECT *, {CELL} AS cell FROM ev), act AS (SELECT *, lead(cell) OVER (PARTITION BY user_id ORDER BY us) AS to_cell FROM a0),
c AS (SELECT cell, count_if(event_type='purchase') AS shots, count_if(event_type='purchase' AND cents % 3 = 0) AS goals, count_if(event_type<>'purchase') AS moves FROM act GROUP BY 1),
ce AS (SELECT cell, coalesce(CASE WHEN shots > 0 THEN goals / shots END, 0.0::DOUBLE) * (shots / (shots + moves)) AS gain, moves / (shots + moves) AS pm FROM c),
tr AS (SELECT act.cell, to_cell, count(*) / any_value(moves) AS p FROM act JOIN c ON c.cell = act.cell WHERE event_type <> 'purchase' AND to_cell IS NOT NULL GROUP BY 1, 2)"""
_ROUNDS = 9  # 2^9 moves in the SQL; the library goes on to its tolerance


def _iterate() -> str:
    out = ", v0 AS MATERIALIZED (SELECT cell, gain AS xt FROM ce), m0 AS MATERIALIZED (SELECT tr.cell, to_cell, p * pm AS p FROM tr JOIN ce ON ce.cell = tr.cell)"
    for i in range(_ROUNDS):
        out += (f", v{i + 1} AS MATERIALIZED (SELECT v.cell, v.xt + coalesce(n.v, 0.0::DOUBLE) AS xt FROM v{i} v LEFT JOIN (SELECT m.cell, sum(p * xt) AS v FROM m{i} m JOIN v{i} q ON q.cell = m.to_cell GROUP BY 1) n ON n.cell = v.cell)"
                f", m{i + 1} AS MATERIALIZED (SELECT a.cell, b.to_cell, sum(a.p * b.p) AS p FROM m{i} a JOIN m{i} b ON b.cell = a.to_cell GROUP BY ALL)")
    return out


def actions(t: Tables):
    from fieldtrace.operators.ordered import next_, scan
    kind = F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "view", 1).when(F.col("event_type") == "error", 2).when(F.col("event_type") == "signup", 3).otherwise(4)
    d = t.ev.withColumn("cell", (kind * 5 + F.least(F.floor(F.col("k") / 20), F.lit(4))).cast("long"))
    return scan(d, ["user_id"], ["us"], {"to_cell": next_(F.col("cell"))})


def surface(t: Tables):
    a = actions(t)
    shot = F.col("event_type") == "purchase"
    cells, tr = values.threat_inputs(a, "cell", "to_cell", shot, F.col("cents") % 3 == 0, ~shot, F.col("to_cell").isNotNull())
    return a, values.threat_surface(cells, tr)


@query("agg43_threat_surface", f"WITH {ACT}{_iterate()} SELECT cell, round(xt * 1e6)::BIGINT AS xt_micro FROM v{_ROUNDS}")
def _(t: Tables):
    return surface(t)[1].select("cell", F.round(F.col("xt") * 1e6).cast("long").alias("xt_micro"))


@query("agg43_rate_moves", f"WITH {ACT}{_iterate()} SELECT event_id, CASE WHEN event_type <> 'purchase' AND to_cell IS NOT NULL THEN round((b.xt - a.xt) * 1e6)::BIGINT END AS xt_micro FROM act JOIN v{_ROUNDS} a ON a.cell = act.cell LEFT JOIN v{_ROUNDS} b ON b.cell = act.to_cell")
def _(t: Tables):
    a, s = surface(t)
    return values.rate_moves(a, s, "cell", "to_cell", (F.col("event_type") != "purchase") & F.col("to_cell").isNotNull()).select(
        "event_id", F.round(F.col("xt") * 1e6).cast("long").alias("xt_micro"))


@query("agg44_possession_values", f"""WITH {EV}, a AS (SELECT event_id, user_id, us, k % 2 AS team, CASE WHEN event_type='purchase' THEN 'shot' WHEN event_type='signup' THEN 'corner_short' ELSE 'pass' END AS ty, cents % 3 = 0 AS ok, k / 200.0::DOUBLE AS sc, (99 - k) / 300.0::DOUBLE AS co FROM ev),
p AS (SELECT *, lag(team) OVER w AS pt, lag(us) OVER w AS pu, lag(sc) OVER w AS ps, lag(co) OVER w AS pc, lag(ty = 'shot' AND ok) OVER w AS pg FROM a WINDOW w AS (PARTITION BY user_id ORDER BY us)),
v AS (SELECT *, CASE WHEN pu IS NULL THEN ty = 'shot' AND ok ELSE abs(pu - us) / 3600000000.0::DOUBLE > 10 OR pg END AS void FROM p)
SELECT event_id, sc - CASE WHEN ty = 'corner_short' THEN 0.0465::DOUBLE WHEN void THEN 0.0::DOUBLE WHEN pu IS NULL THEN sc WHEN pt = team THEN ps ELSE pc END AS offensive_value,
  CASE WHEN void THEN 0.0::DOUBLE WHEN pu IS NULL THEN co WHEN pt = team THEN pc ELSE ps END - co AS defensive_value FROM v""")
def _(t: Tables):
    """Hours stand in for seconds, so the ten-second phase rule becomes ten hours."""
    ty = F.when(F.col("event_type") == "purchase", "shot").when(F.col("event_type") == "signup", "corner_short").otherwise("pass")
    a = t.ev.select("event_id", "user_id", "us", (F.col("k") % 2).alias("team_id"), (F.col("us") / 3.6e9).alias("time_seconds"), ty.alias("type_name"), (F.col("cents") % 3 == 0).alias("success"),
                    (F.col("k") / 200.0).alias("scores"), ((F.lit(99) - F.col("k")) / 300.0).alias("concedes"))
    return values.possession_values(a, ["user_id"], ["us"]).select("event_id", "offensive_value", "defensive_value")


@query("win43_action_labels", f"""WITH {EV}, a AS (SELECT event_id, user_id, us, k % 2 AS team, event_type='purchase' AND cents % 3 = 0 AS goal, event_type='error' AND cents % 5 = 0 AS own FROM ev)
SELECT event_id, coalesce(max(CASE WHEN (team = 0 AND goal) OR (team = 1 AND own) THEN 1 ELSE 0 END) OVER w = 1, false) AS zero_gains, coalesce(max(CASE WHEN (team = 1 AND goal) OR (team = 0 AND own) THEN 1 ELSE 0 END) OVER w = 1, false) AS one_gains FROM a
WINDOW w AS (PARTITION BY user_id ORDER BY us ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)""")
def _(t: Tables):
    a = t.ev.select("event_id", "user_id", "us", (F.col("k") % 2).alias("team_id"), ((F.col("event_type") == "purchase") & (F.col("cents") % 3 == 0)).alias("goal"),
                    ((F.col("event_type") == "error") & (F.col("cents") % 5 == 0)).alias("own_goal"))
    d = values.action_labels(a, ["user_id"], ["us"])
    zero = F.col("team_id") == 0
    return d.select("event_id", F.when(zero, F.col("scores")).otherwise(F.col("concedes")).alias("zero_gains"), F.when(zero, F.col("concedes")).otherwise(F.col("scores")).alias("one_gains"))


@query("win43_action_features", f"""WITH {EV} SELECT event_id, (event_type = 'click')::INT::DOUBLE AS type_click, sqrt(abs(105.0::DOUBLE - k) * abs(105.0::DOUBLE - k) + abs(34.0::DOUBLE - cents % 68) * abs(34.0::DOUBLE - cents % 68)) AS start_dist_to_goal,
 sqrt((cents % 100 - k)::DOUBLE * (cents % 100 - k) + (k % 68 - cents % 68)::DOUBLE * (k % 68 - cents % 68)) AS movement FROM ev""")
def _(t: Tables):
    a = t.ev.select("event_id", F.col("event_type").alias("type_name"), F.lit("success").alias("result_name"), F.lit("foot").alias("bodypart_name"), F.col("k").alias("start_x"), (F.col("cents") % 68).alias("start_y"),
                    (F.col("cents") % 100).alias("end_x"), (F.col("k") % 68).alias("end_y"))
    return values.action_features(a, ["click", "view"], ["success"], ["foot"]).select("event_id", "type_click", "start_dist_to_goal", "movement")
