"""Grid sampling, filling and feature rows, and the basketball plan over event-shaped rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtrace.operators import features, grid, islands
from fieldtrace.plans import hoops
from fieldtrace.plans.registry import DAY, EV, HOUR, Tables, query
from fieldtrace.session import cut_lineage


@query("win06_grid_sample", f"""WITH {EV} SELECT event_id, user_id, us FROM ev QUALIFY row_number() OVER (PARTITION BY user_id, us // {DAY} ORDER BY us) = 1""")
def _(t: Tables):
    return grid.grid_sample(t.ev.select("event_id", "user_id", "us"), ["user_id"], ["us"], DAY)


@query("win08_interpolate", f"""WITH {EV}, n AS (SELECT user_id, us, event_id, k, lead(us) OVER w AS nu, lead(event_id) OVER w AS ne, lead(k) OVER w AS nk FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us)),
x AS (SELECT *, unnest(CASE WHEN nu - us > {3 * HOUR} AND nu - us <= {20 * HOUR} THEN range(0, (nu - us - 1) // {3 * HOUR} + 1) ELSE [0] END) AS i FROM n),
f AS (SELECT *, i * {float(3 * HOUR)!r}::DOUBLE / (nu - us) AS f FROM x)
SELECT user_id, CASE WHEN i > 0 THEN us + CAST(floor((nu - us) * f) AS BIGINT) ELSE us END AS us, CASE WHEN i > 0 THEN event_id + CAST(round_even((ne - event_id) * f, 0) AS BIGINT) ELSE event_id END AS frame,
  CASE WHEN i > 0 THEN k + (nk - k) * f ELSE k::DOUBLE END AS k, i > 0 AS interpolated FROM f""")
def _(t: Tables):
    """Rows every 3 h inside gaps of up to 20 h."""
    d = t.ev.select("user_id", "us", F.col("event_id").alias("frame"), "k")
    return grid.interpolate_gaps(d, ["user_id"], "us", "frame", ["k"], 3 * HOUR, 20 * HOUR)


@query("win09_linear_fill", f"""WITH {EV}, b AS (SELECT user_id, us // {12 * HOUR} - (SELECT min(us) FROM ev) // {12 * HOUR} AS bin, max(k) AS v FROM ev GROUP BY 1, 2),
sp AS (SELECT user_id, unnest(range(0, max(bin) + 1)) AS bin FROM b GROUP BY user_id),
j AS (SELECT sp.user_id, sp.bin, v FROM sp LEFT JOIN b ON b.user_id = sp.user_id AND b.bin = sp.bin),
f AS (SELECT *, last_value(v IGNORE NULLS) OVER p AS pv, last_value(CASE WHEN v IS NOT NULL THEN bin END IGNORE NULLS) OVER p AS pb,
  first_value(v IGNORE NULLS) OVER n AS nv, first_value(CASE WHEN v IS NOT NULL THEN bin END IGNORE NULLS) OVER n AS nb FROM j
  WINDOW p AS (PARTITION BY user_id ORDER BY bin ROWS UNBOUNDED PRECEDING), n AS (PARTITION BY user_id ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT user_id, bin, v, CASE WHEN pv IS NOT NULL AND nv IS NOT NULL THEN CASE WHEN nb = pb THEN pv::DOUBLE ELSE pv::DOUBLE + (nv::DOUBLE - pv::DOUBLE) * ((bin - pb)::DOUBLE / (nb - pb)) END END AS filled, pv IS NOT NULL AND nv IS NOT NULL AS valid FROM f""")
def _(t: Tables):
    step = F.lit(12 * HOUR)
    low = t.ev.agg(F.floor(F.min("us") / step).alias("_lo"))
    b = t.ev.join(F.broadcast(low), F.lit(True)).groupBy("user_id", (F.floor(F.col("us") / step) - F.col("_lo")).alias("bin")).agg(F.max("k").alias("v"))  # one-row bound
    spine = grid.dense_spine(b, ["user_id"], "bin").join(b, ["user_id", "bin"], "left")
    return grid.linear_fill(spine, ["user_id"], "bin", "v")


@query("win09_stitch", f"""WITH {EV}, s AS (SELECT user_id, us // {3 * DAY} AS seg, min(us) AS t0, max(us) AS t1, arg_min(k, us) AS h, arg_max(k, us) AS tl FROM ev GROUP BY 1, 2),
p AS (SELECT *, lag(t1) OVER w AS pt, lag(tl) OVER w AS pk FROM s WINDOW w AS (PARTITION BY user_id ORDER BY t0))
SELECT user_id, seg, CAST(sum(CASE WHEN t0 - pt <= {15 * HOUR} AND abs(h - pk) <= {1e-9!r}::DOUBLE * (t0 - pt) THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY t0) AS BIGINT) AS chain FROM p""")
def _(t: Tables):
    s = t.ev.groupBy("user_id", F.floor(F.col("us") / F.lit(3 * DAY)).alias("seg")).agg(
        F.min("us").alias("t0"), F.max("us").alias("t1"), F.min_by("k", "us").alias("h"), F.max_by("k", "us").alias("tl"))
    d = grid.stitch_segments(s, ["user_id"], "t0", "t1", F.col("h"), F.col("tl"), 15 * HOUR, 1e-9)
    return d.select("user_id", "seg", "chain")


@query("win18_smear", f"""WITH {EV}, b AS (SELECT DISTINCT user_id, us // {12 * HOUR} AS bin FROM ev WHERE event_type = 'purchase') SELECT DISTINCT user_id, bin + o AS bin FROM b, (SELECT unnest([-2,-1,0,1,2]) AS o)""")
def _(t: Tables):
    a = t.ev.filter("event_type = 'purchase'").select("user_id", F.floor(F.col("us") / F.lit(12 * HOUR)).alias("bin"))
    return grid.smear_targets(a, ["user_id"], "bin", 2)


@query("win19_mapping_replay", f"""WITH {EV}, c AS (SELECT k % 10 AS game, us, user_id AS true_id, cents % 20 AS obs, us // {DAY} AS b FROM ev WHERE event_type = 'click'),
l AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY game, true_id, b ORDER BY us DESC) = 1),
u AS (SELECT *, lead(b) OVER (PARTITION BY game, true_id ORDER BY b) AS nb, max(b) OVER (PARTITION BY game) AS lb FROM l),
x AS (SELECT game, true_id, obs, us, unnest(range(b, coalesce(nb - 1, lb) + 1)) AS bin FROM u)
SELECT game, bin, obs, true_id FROM x QUALIFY row_number() OVER (PARTITION BY game, bin, obs ORDER BY us DESC) = 1""")
def _(t: Tables):
    c = t.ev.filter("event_type = 'click'").select((F.col("k") % 10).alias("game"), "us", F.col("user_id").alias("true_id"), (F.col("cents") % 20).alias("obs"), F.floor(F.col("us") / F.lit(DAY)).alias("b"))
    return grid.replay_mapping(c, ["game"], "us", "true_id", "obs", "b")


@query("win27_bucket_flow", f"""WITH {EV}, c AS (SELECT user_id % 5 AS g, us // {6 * HOUR} AS b, sum(k) AS s, count(k) AS n FROM ev WHERE event_type <> 'purchase' GROUP BY 1, 2),
w AS (SELECT event_id, user_id % 5 AS g, us, CASE k % 3 WHEN 0 THEN 'left' WHEN 1 THEN 'right' END AS side FROM ev WHERE event_type = 'purchase'),
m AS (SELECT event_id, (SELECT sum(s)::DOUBLE / sum(n)::DOUBLE FROM c WHERE c.g = w.g AND c.b BETWEEN (us + {12 * HOUR}) // {6 * HOUR} - 1 AND (us + {12 * HOUR}) // {6 * HOUR} + 1) AS c0,
  (SELECT sum(s)::DOUBLE / sum(n)::DOUBLE FROM c WHERE c.g = w.g AND c.b BETWEEN (us + {48 * HOUR}) // {6 * HOUR} - 1 AND (us + {48 * HOUR}) // {6 * HOUR} + 1) AS c1 FROM w)
SELECT w.event_id, (c1 - c0) * CASE side WHEN 'right' THEN -1.0::DOUBLE WHEN 'left' THEN 1.0::DOUBLE END AS flow FROM w JOIN m USING (event_id)""")
def _(t: Tables):
    p = t.ev.filter("event_type <> 'purchase'").select((F.col("user_id") % 5).alias("g"), "us", "k")
    w = t.ev.filter("event_type = 'purchase'").select("event_id", (F.col("user_id") % 5).alias("g"), "us", F.when(F.col("k") % 3 == 0, "left").when(F.col("k") % 3 == 1, "right").alias("side"))
    return grid.bucket_flow(p, w, ["g"], "us", "k", "event_id", "us", "side", 6 * HOUR, 12 * HOUR, 48 * HOUR).select("event_id", "flow")


@query("agg31_longest_gap", f"""WITH {EV}, b AS (SELECT min(us) AS lo, max(us) AS hi FROM ev), d AS (SELECT user_id, us, lag(us) OVER w AS p, lead(us) OVER w AS n FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us))
SELECT user_id, max(greatest(us - coalesce(p, lo), CASE WHEN n IS NULL THEN hi - us END)) AS longest_gap, count(*) AS n FROM d, b GROUP BY 1""")
def _(t: Tables):
    bounds = t.ev.agg(F.min("us").alias("lo"), F.max("us").alias("hi"))
    d = t.ev.select("user_id", "us").join(F.broadcast(bounds), F.lit(True))  # one-row bound
    return grid.longest_gap(d, ["user_id"], "us", "lo", "hi")


# A user is a game; two-hour ticks keep the grid small.
TICK = 2 * HOUR
CHANNEL = {"click": "ball", "view": "player", "purchase": "ball_control", "error": "rim", "signup": "pbp_anchor"}
TOK = f"""{EV}, base AS (SELECT min(us) AS lo FROM ev), tk AS (SELECT user_id AS game, (us - lo) AS t_ms, event_id AS seq, CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in CHANNEL.items())} END AS channel,
  k % 12 AS entity_id, k % 2 AS team, k::DOUBLE AS x, (cents % 50)::DOUBLE AS y, (cents % 10)::DOUBLE AS value, k::DOUBLE / 100.0::DOUBLE AS conf FROM ev, base)"""


def token_channels(t: Tables):
    base = t.ev.agg(F.min("us").alias("lo"))
    d = t.ev.join(F.broadcast(base), F.lit(True)).select(  # one-row bound
        F.col("user_id").alias("game"), (F.col("us") - F.col("lo")).alias("t_ms"), F.col("event_id").alias("seq"), "event_type", (F.col("k") % 12).alias("entity_id"),
        (F.col("k") % 2).alias("team_cluster"), F.col("k").cast("double").alias("court_x"), (F.col("cents") % 50).cast("double").alias("court_y"),
        (F.col("cents") % 10).cast("double").alias("value"), (F.col("k") / 100.0).alias("conf"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("int").alias("period"),
        F.lit(None).cast("long").alias("track_id"))
    return {ch: d.filter(F.col("event_type") == e).drop("event_type") for e, ch in CHANNEL.items()}


@query("ord01_token_stream", f"""WITH {TOK} SELECT game, t_ms, channel, seq, row_number() OVER (PARTITION BY game ORDER BY t_ms, CASE channel WHEN 'rim' THEN 3 WHEN 'player' THEN 4 WHEN 'ball' THEN 5 WHEN 'ball_control' THEN 6 ELSE 9 END, entity_id, seq) - 1 AS token_idx FROM tk""")
def _(t: Tables):
    return features.token_stream(token_channels(t), "game").select("game", "t_ms", "channel", "seq", "token_idx")


@query("src19_stream_meta", f"""WITH {TOK}, n AS (SELECT game, channel, count(*) AS n FROM tk GROUP BY 1, 2) SELECT game, CAST(sum(n) AS BIGINT) AS total, string_agg(channel || '=' || n, ',' ORDER BY channel) AS channels FROM n GROUP BY 1""")
def _(t: Tables):
    m = features.stream_meta(features.token_stream(token_channels(t), "game"), "game")
    return m.select("game", "total", F.array_join(F.transform("channels", lambda c: F.concat_ws("=", c["channel"], c["n"].cast("string"))), ",").alias("channels"))


@query("win15_game_grid", f"""WITH {TOK}, o AS (SELECT *, t_ms // {TICK} AS bin FROM tk WHERE channel <> 'pbp_anchor'),
sp AS (SELECT game, unnest(range(0, max(bin) + 1)) AS bin FROM o GROUP BY game),
g AS (SELECT game, bin, count_if(channel='ball') AS nb, arg_max(x, seq) FILTER (channel='ball') AS bx, arg_max(y, seq) FILTER (channel='ball') AS byy, count_if(channel='rim') AS nr, arg_max(x, seq) FILTER (channel='rim') AS rx, arg_max(y, seq) FILTER (channel='rim') AS ry,
  count_if(channel='player') AS np, min(least(CASE WHEN value = 0 THEN 10.0::DOUBLE ELSE value END / 10.0::DOUBLE, 1.0::DOUBLE)) FILTER (channel='ball_control') AS ctl,
  (sum(x::DECIMAL(28,9)) FILTER (channel='player' AND team=0))::DOUBLE / count(*) FILTER (channel='player' AND team=0) AS tx0, count(*) AS nt FROM o GROUP BY 1, 2),
j AS (SELECT sp.game, sp.bin, g.* EXCLUDE (game, bin), lag(nb) OVER w AS pnb, lag(bx) OVER w AS pbx FROM sp LEFT JOIN g ON g.game = sp.game AND g.bin = sp.bin WINDOW w AS (PARTITION BY sp.game ORDER BY sp.bin))
SELECT game, bin, least(coalesce(nb, 0) / 4.0::DOUBLE, 1.0::DOUBLE) AS ball_count, coalesce(bx / 94.0::DOUBLE, 0) AS ball_x, coalesce(ctl, 0) AS control_min, least(coalesce(np, 0) / 12.0::DOUBLE, 1.0::DOUBLE) AS players,
  coalesce(tx0 / 94.0::DOUBLE, 0) AS team0_x, CASE WHEN nb > 0 AND nr > 0 AND sqrt((bx-rx)*(bx-rx)+(byy-ry)*(byy-ry)) < 6 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS near_rim,
  CASE WHEN nb > 0 AND pnb > 0 THEN greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (bx - pbx) / 10.0::DOUBLE)) ELSE 0.0::DOUBLE END AS ball_vx, least(coalesce(nt, 0) / 50.0::DOUBLE, 1.0::DOUBLE) AS tokens FROM j""")
def _(t: Tables):
    g = features.game_grid(features.token_stream(token_channels(t), "game"), "game", TICK)
    return g.select("game", "bin", "ball_count", "ball_x", "control_min", "players", "team0_x", "near_rim", "ball_vx", "tokens")


@query("win17_ball_grid", f"""WITH {TOK}, o AS (SELECT *, t_ms // {TICK} AS bin FROM tk WHERE channel <> 'pbp_anchor'),
sp AS (SELECT game, unnest(range(0, max(bin) + 1)) AS bin FROM o GROUP BY game),
g AS (SELECT game, bin, arg_max(x, (conf, seq)) AS bx FROM o WHERE channel = 'ball' GROUP BY 1, 2),
j AS (SELECT sp.game, sp.bin, bx / 94.0::DOUBLE AS x FROM sp LEFT JOIN g ON g.game = sp.game AND g.bin = sp.bin),
f AS (SELECT *, last_value(x IGNORE NULLS) OVER w AS last_x, last_value(CASE WHEN x IS NOT NULL THEN bin END IGNORE NULLS) OVER w AS lb FROM j WINDOW w AS (PARTITION BY game ORDER BY bin ROWS UNBOUNDED PRECEDING))
SELECT game, bin, x, last_x, coalesce(least((bin - lb) / 40.0::DOUBLE, 1.0::DOUBLE), 1.0::DOUBLE) AS age FROM f""")
def _(t: Tables):
    g = features.ball_grid(features.token_stream(token_channels(t), "game"), "game", TICK, 40)
    return g.select("game", "bin", "x", "last_x", "age")


@query("win16_track_grid", f"""WITH {TOK}, o AS MATERIALIZED (SELECT *, t_ms // {TICK} AS bin FROM tk WHERE channel <> 'pbp_anchor'),
tr AS MATERIALIZED (SELECT game, entity_id FROM (SELECT game, entity_id, count(*) AS n FROM tk WHERE channel IN ('player','ball_control') GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY game ORDER BY n DESC, entity_id) <= 16),
sp AS MATERIALIZED (SELECT s.game, s.bin, tr.entity_id FROM (SELECT game, unnest(range(0, max(bin) + 1)) AS bin FROM o GROUP BY game) s JOIN tr USING (game)),
c AS MATERIALIZED (SELECT game, entity_id, bin, arg_max(x, seq) FILTER (channel='player') AS x, arg_max(y, seq) FILTER (channel='player') AS y, max(conf) FILTER (channel='player') AS conf FROM o WHERE channel IN ('player','ball_control') GROUP BY 1, 2, 3),
b AS MATERIALIZED (SELECT game, bin, arg_max(x, seq) AS bx, arg_max(y, seq) AS byy FROM o WHERE channel='ball' GROUP BY 1, 2),
j AS MATERIALIZED (SELECT sp.game, sp.bin, sp.entity_id, c.x, c.y, c.conf, b.bx, b.byy FROM sp LEFT JOIN c ON c.game=sp.game AND c.bin=sp.bin AND c.entity_id=sp.entity_id LEFT JOIN b ON b.game=sp.game AND b.bin=sp.bin),
pr AS MATERIALIZED (SELECT game, bin, entity_id, x, y FROM j WHERE x IS NOT NULL), n AS MATERIALIZED (SELECT a.game, a.bin, a.entity_id, min(sqrt((a.x-z.x)*(a.x-z.x)+(a.y-z.y)*(a.y-z.y))) AS d FROM pr a JOIN pr z ON a.game=z.game AND a.bin=z.bin WHERE a.entity_id<>z.entity_id GROUP BY 1, 2, 3)
SELECT j.game, j.bin, j.entity_id, CASE WHEN j.x IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS present, coalesce(j.x / 94.0::DOUBLE, 0) AS x, coalesce(conf, 0) AS conf,
  coalesce(CASE WHEN j.x IS NOT NULL AND bx IS NOT NULL THEN least(sqrt((j.x-bx)*(j.x-bx)+(j.y-byy)*(j.y-byy)) / 10.0::DOUBLE, 1.0::DOUBLE) END, 0) AS ball_distance, coalesce(CASE WHEN n.d IS NOT NULL THEN least(n.d / 10.0::DOUBLE, 1.0::DOUBLE) END, 0) AS neighbour_distance
FROM j LEFT JOIN n ON n.game=j.game AND n.bin=j.bin AND n.entity_id=j.entity_id""")
def _(t: Tables):
    s = features.token_stream(token_channels(t), "game")
    g = features.track_grid(s, features.top_tracks(s, "game"), "game", TICK)
    return g.select("game", "bin", "entity_id", "present", "x", "conf", "ball_distance", "neighbour_distance")


@query("win13_local_references")
def _(t: Tables):
    """Median reference boxes near each purchase (frame = two-hour tick of the user)."""
    d = t.ev.select("user_id", F.floor(F.col("us") / F.lit(TICK)).alias("frame"), F.col("event_id").alias("box_id"), F.col("k").cast("double").alias("x1"), F.lit(0.0).alias("y1"),
                    (F.col("k") + 10).cast("double").alias("x2"), F.lit(10.0).alias("y2"), "event_type")
    return features.local_references(d.filter("event_type = 'error'").drop("event_type"), d.filter("event_type = 'purchase'"), "user_id", "frame", 45, 15, 30.0)


# Court rows: thirty jobs of users; events are people and balls, a frame is a two-hour tick.
def court(t: Tables, kept: bool = True):
    pos = t.ev.filter("event_type <> 'error'").select(
        (F.col("user_id") % 30).alias("job_id"), F.floor(F.col("us") / F.lit(TICK)).alias("frame_idx"), F.col("us").alias("ts_ms"), F.col("event_id").alias("det_idx"),
        F.when(F.col("event_type") == "click", 1).otherwise(0).alias("cls"), F.when(F.col("event_type") != "click", F.col("k") % 12).alias("entity_id"),
        F.when(F.col("event_type") != "click", F.col("k") % 2).alias("team_cluster"), F.col("k").cast("double").alias("court_x"), (F.col("cents") % 50).cast("double").alias("court_y"), F.lit(1.0).alias("court_conf"))
    cfg = hoops.Hoops(control_radius=25.0, bridge=4 * DAY, min_possession=6 * HOUR, handoff=2 * DAY, hold=4 * DAY, shooter_lookback=2 * DAY, rebound_ahead=3 * DAY)
    ctl = hoops.ball_controls(pos, cfg, fill=False)
    return pos, cut_lineage(ctl) if kept else ctl, cfg  # kept: the scans behind read the controls, none makes them again


CTL = f"""{EV}, pos AS (SELECT user_id % 30 AS job_id, us // {TICK} AS f, us, event_id, event_type, k % 12 AS e, k % 2 AS tm, k::DOUBLE AS x, (cents % 50)::DOUBLE AS y FROM ev WHERE event_type <> 'error'),
ctl AS (SELECT b.job_id, b.us, p.e, p.tm, p.x, p.y, sqrt((p.x-b.x)*(p.x-b.x)+(p.y-b.y)*(p.y-b.y)) AS d FROM pos b JOIN pos p ON b.job_id=p.job_id AND b.f=p.f AND b.event_type='click' AND p.event_type<>'click'
  QUALIFY row_number() OVER (PARTITION BY b.job_id, b.us ORDER BY sqrt((p.x-b.x)*(p.x-b.x)+(p.y-b.y)*(p.y-b.y)), p.event_id) = 1),
ct AS (SELECT * FROM ctl WHERE d <= 25)"""


@query("hoops_controls", f"WITH {CTL} SELECT job_id, us AS ts_ms, e AS entity_id, tm AS team_cluster, d AS dist_ft FROM ct")
def _(t: Tables):
    return court(t, kept=False)[1].select("job_id", "ts_ms", "entity_id", "team_cluster", "dist_ft")


@query("agg11_box_score", f"""WITH {CTL}, shots AS (SELECT user_id % 30 AS job_id, event_id, us, CASE WHEN k < 50 THEN 'left' ELSE 'right' END AS "end", k % 3 = 0 AS made, k % 7 = 0 AS ft FROM ev WHERE event_type='error'),
a AS (SELECT s.*, c.us AS cu, c.e, c.tm, c.x, c.y FROM shots s ASOF LEFT JOIN ct c ON s.job_id=c.job_id AND s.us >= c.us),
s1 AS (SELECT job_id, event_id, us, "end", made, ft, CASE WHEN us - cu <= {2 * DAY} THEN e END AS e, CASE WHEN us - cu <= {2 * DAY} THEN tm END AS tm, CASE WHEN us - cu <= {2 * DAY} THEN x END AS x, CASE WHEN us - cu <= {2 * DAY} THEN y END AS y FROM a),
s2 AS (SELECT *, NOT ft AND coalesce(sqrt((x - CASE WHEN "end"='left' THEN 5.25::DOUBLE ELSE 88.75::DOUBLE END)*(x - CASE WHEN "end"='left' THEN 5.25::DOUBLE ELSE 88.75::DOUBLE END)+(y-25)*(y-25)) > 22.146::DOUBLE OR abs(y-25) > 25.0::DOUBLE - 3.344::DOUBLE, false) AS three FROM s1),
run AS (SELECT *, lag(e) OVER w AS pe, lag(tm) OVER w AS pm, lag(us) OVER w AS pu FROM ct WINDOW w AS (PARTITION BY job_id ORDER BY us)),
rid AS (SELECT *, sum(CASE WHEN pe IS NULL OR pe <> e THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY us) AS r FROM run),
hd AS (SELECT job_id, r, min(us) AS t, arg_min(tm, us) AS m, arg_min(pe, us) AS pe, arg_min(pm, us) AS pm, arg_min(pu, us) AS pu FROM rid GROUP BY 1, 2),
la AS (SELECT s.job_id, s.event_id, s.us, s.e, c.us AS cu FROM (SELECT * FROM s2 WHERE made AND NOT ft AND e IS NOT NULL) s ASOF JOIN ct c ON s.job_id=c.job_id AND s.us >= c.us),
ast AS (SELECT la.job_id, hd.pe AS e, hd.pm AS tm FROM la JOIN rid ON rid.job_id=la.job_id AND rid.us=la.cu JOIN hd ON hd.job_id=rid.job_id AND hd.r=rid.r WHERE rid.e=la.e AND la.us - hd.t <= {4 * DAY} AND hd.pe IS NOT NULL AND hd.pm = hd.m AND hd.t - hd.pu <= {2 * DAY}),
rb AS (SELECT s.job_id, s.tm AS st, c.e, c.tm, c.us - s.us AS g FROM (SELECT * FROM s2 WHERE NOT made) s ASOF JOIN ct c ON s.job_id=c.job_id AND s.us < c.us),
al AS (SELECT job_id, coalesce(tm, -1) AS team, CASE WHEN e IS NULL THEN 'team' WHEN e % 3 = 0 THEN 'Player ' || e ELSE 'e' || e END AS pk, (NOT ft)::INT AS fga, (made AND NOT ft)::INT AS fgm, three::INT AS fga3, (three AND made)::INT AS fgm3, ft::INT AS fta, (ft AND made)::INT AS ftm, CASE WHEN made THEN CASE WHEN ft THEN 1 WHEN three THEN 3 ELSE 2 END ELSE 0 END AS points, 0 AS ast, 0 AS oreb, 0 AS dreb FROM s2
  UNION ALL SELECT job_id, tm, CASE WHEN e % 3 = 0 THEN 'Player ' || e ELSE 'e' || e END, 0,0,0,0,0,0,0, 1, 0, 0 FROM ast UNION ALL SELECT job_id, tm, CASE WHEN e % 3 = 0 THEN 'Player ' || e ELSE 'e' || e END, 0,0,0,0,0,0,0,0, coalesce(tm = st, false)::INT, 1 - coalesce(tm = st, false)::INT FROM rb WHERE g <= {3 * DAY})
SELECT job_id, team, pk AS player_key, sum(fga)::BIGINT AS fga, sum(fgm)::BIGINT AS fgm, sum(fga3)::BIGINT AS fga3, sum(fgm3)::BIGINT AS fgm3, sum(fta)::BIGINT AS fta, sum(ftm)::BIGINT AS ftm, sum(points)::BIGINT AS points, sum(ast)::BIGINT AS ast, sum(oreb)::BIGINT AS oreb, sum(dreb)::BIGINT AS dreb FROM al GROUP BY 1, 2, 3""")
def _(t: Tables):
    """Errors play the shots, some of them free throws; shooter, assist and rebounder come from the control stream, a third of the players has names."""
    _, ctl, cfg = court(t)
    shots = t.ev.filter("event_type = 'error'").select((F.col("user_id") % 30).alias("job_id"), "event_id", F.col("us").alias("ts_start_ms"), F.col("us").alias("ts_end_ms"),
                                                       F.when(F.col("k") < 50, "left").otherwise("right").alias("court_end"), (F.col("k") % 3 == 0).alias("verdict_made"), F.lit(0.9).alias("confidence"))
    names = ctl.filter(F.col("entity_id") % 3 == 0).select("job_id", "entity_id", F.concat(F.lit("Player "), F.col("entity_id").cast("string")).alias("name")).distinct()
    ft = t.ev.filter("event_type = 'error'").select((F.col("user_id") % 30).alias("job_id"), "event_id", (F.col("k") % 7 == 0).alias("is_ft"))
    box = hoops.box_score(hoops.box_events(shots, ctl, names, ft, cfg))
    return box.select("job_id", "team", "player_key", "fga", "fgm", "fga3", "fgm3", "fta", "ftm", "points", "ast", "oreb", "dreb")


@query("agg13_box_totals", f"""WITH b AS (SELECT c_nationkey AS job_id, c_mktsegment AS bucket, count(*) AS fga, count_if(c_acctbal > 0) AS fgm, count_if(c_acctbal > 5000) AS fga3 FROM customer GROUP BY 1, 2) SELECT job_id, bucket, fga, fgm, fga - fga3 AS fga2 FROM b""")
def _(t: Tables):
    c = t.customer
    zero = F.lit(0).cast("long")
    one = lambda cond: F.when(cond, 1).otherwise(0).cast("long")
    b = c.select(F.col("c_nationkey").alias("job_id"), F.col("c_mktsegment").alias("player_key"), F.lit(0).alias("team"), F.lit(1).cast("long").alias("fga"), one(F.col("c_acctbal") > 0).alias("fgm"),
                 one(F.col("c_acctbal") > 5000).alias("fga3"), *[zero.alias(s) for s in ("fgm3", "fta", "ftm", "ast", "oreb", "dreb", "points")])
    d = hoops.box_totals(b.withColumn("team", F.col("player_key")))
    return d.select("job_id", F.expr("substring(bucket, 5)").alias("bucket"), "fga", "fgm", "fga2")


@query("hoops_events", f"""WITH {CTL}, o AS (SELECT *, lag(e) OVER w AS pe, lag(us) OVER w AS pu, lag(tm) OVER w AS pt FROM ct WINDOW w AS (PARTITION BY job_id ORDER BY us))
SELECT job_id, us AS ts_ms, CASE WHEN pe IS NULL OR us - pu > {2 * DAY} THEN 'control_gain' WHEN pt = tm THEN 'pass_candidate' ELSE 'steal_candidate' END AS event_type FROM o WHERE pe IS NULL OR pe <> e""")
def _(t: Tables):
    _, ctl, cfg = court(t)
    ev = hoops.atomic_events(ctl, hoops.possessions(ctl, cfg), cfg)
    return ev.filter(~F.col("event_type").startswith("possession")).select("job_id", "ts_ms", "event_type")


@query("win42_play_payloads")
def _(t: Tables):
    """One JSON document per possession of the control stream."""
    _, ctl, cfg = court(t)
    poss = hoops.possessions(ctl, cfg)
    ev = hoops.atomic_events(ctl, poss, cfg).drop("possession_id").filter("entity_id is not null")
    shots = t.ev.filter("event_type = 'error'").select((F.col("user_id") % 30).alias("job_id"), F.col("us").alias("shot_ts"), (F.col("k") % 3 == 0).alias("made"))
    return hoops.play_payloads(poss, ev.select("job_id", "ts_ms", "event_type", "entity_id"), shots, "possession_id", 2 * HOUR, DAY)


@query("win30_free_throws")
def _(t: Tables):
    pos, ctl, cfg = court(t)
    shots = t.ev.filter("event_type = 'error'").select((F.col("user_id") % 30).alias("job_id"), "event_id", F.col("us").alias("ts_start_ms"), F.when(F.col("k") < 50, "left").otherwise("right").alias("court_end"))
    return hoops.free_throws(shots, ctl, pos, cfg, window=2 * DAY, radius=30.0, still=40.0)


@query("win11_contact_grammar")
def _(t: Tables):
    """Contact grammar over click tracks with view bodies and error rims per user (frame = two-hour tick)."""
    fr = F.floor(F.col("us") / F.lit(TICK))
    one = t.ev.groupBy("user_id", fr.alias("frame")).agg(F.min_by(F.struct("k", "cents", "us"), "us").alias("r"))
    tr = one.select(F.col("user_id").alias("job_id"), "frame", (F.col("r.us") / 1e6).cast("long").alias("ts"), F.floor(F.col("frame") / 100).alias("seg"), F.col("r.k").cast("double").alias("x"),
                    (F.col("r.cents") % 100).cast("double").alias("y"), F.when(F.col("r.k") % 9 == 0, "interp").otherwise("det").alias("source"))
    k = F.col("k").cast("double")
    b = t.ev.filter("event_type = 'view'").select(F.col("user_id").alias("job_id"), fr.alias("frame"), (F.col("k") % 3).alias("track_id"), k.alias("x1"), F.lit(0.0).alias("y1"), (k + 60).alias("x2"), F.lit(80.0).alias("y2"))
    r = t.ev.filter("event_type = 'error'").select(F.col("user_id").alias("job_id"), fr.alias("frame"), k.alias("x1"), F.lit(20.0).alias("y1"), (k + 40).alias("x2"), F.lit(90.0).alias("y2"))
    return hoops.contact_events(tr, b, r, refractory=100_000, flight=(100, 400_000), scramble=200_000)
