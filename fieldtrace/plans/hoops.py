"""Basketball plans: positions, controls, possessions, events, contacts, free throws, box score, plays.

Tables carry ``job_id`` (one game or clip), so one plan covers any number of games.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldtrace.functions import geometry as G
from fieldtrace.functions.text import is_free_throw
from fieldtrace.operators import asof, folds, grid, interval, islands, pairs
from fieldtrace.operators.ordered import fill_forward, next_, prev, row_number, running_sum, scan, top_k
from fieldtrace.session import spread

PERSON, BALL, REF, RIM = 0, 1, 2, 3


@dataclass(frozen=True)
class Hoops:
    """Fixed values of the basketball plans (feet and milliseconds)."""

    control_radius: float = 6.0
    bridge: int = 4000
    min_possession: int = 2000
    handoff: int = 2000
    hold: int = 4000
    fill_step: int = 150
    fill_gap: int = 1500
    shooter_lookback: int = 2500
    rebound_ahead: int = 5000


def positions(localized: DataFrame, entities: DataFrame) -> DataFrame:
    """On-court located rows of the two teams and of the ball."""
    inside = F.col("court_x").isNotNull() & G.on_court(F.col("court_x").cast("double"), F.col("court_y").cast("double"))
    teams = entities.filter(F.col("team_cluster").isin(0, 1)).select("job_id", "track_id", "entity_id", "team_cluster")
    d = localized.filter(inside & F.col("cls").isin(PERSON, BALL)).join(teams, ["job_id", "track_id"], "left")
    return d.filter((F.col("cls") == BALL) | F.col("entity_id").isNotNull()).select(
        "job_id", "frame_idx", F.col("ts_ms").cast("long").alias("ts_ms"), "det_idx", "cls",
        F.when(F.col("cls") == PERSON, F.col("entity_id")).alias("entity_id"), F.when(F.col("cls") == PERSON, F.col("team_cluster")).alias("team_cluster"),
        F.col("court_x").cast("double").alias("court_x"), F.col("court_y").cast("double").alias("court_y"), "court_conf")


def ball_controls(pos: DataFrame, cfg: Hoops = Hoops(), fill: bool = True) -> DataFrame:
    """JOIN-01 over observed and interpolated (WIN-08) ball rows."""
    balls = pos.filter(F.col("cls") == BALL).select("job_id", F.col("frame_idx").cast("long").alias("frame_idx"), "ts_ms", "court_x", "court_y")
    if fill:
        balls = grid.interpolate_gaps(balls, ["job_id"], "ts_ms", "frame_idx", ["court_x", "court_y"], cfg.fill_step, cfg.fill_gap)
    else:
        balls = balls.withColumn("interpolated", F.lit(False))
    balls = balls.select("job_id", "frame_idx", "ts_ms", F.col("court_x").alias("ball_x"), F.col("court_y").alias("ball_y"), "interpolated").distinct()
    # one person for each place: of those at one distance the smallest det_idx counts, so repeated rows make no further pairs
    place = ["job_id", "frame_idx", "court_x", "court_y"]
    people = pos.filter(F.col("cls") == PERSON).withColumn("frame_idx", F.col("frame_idx").cast("long")).groupBy(*place).agg(
        F.min_by(F.struct("entity_id", "team_cluster"), "det_idx").alias("_who"), F.min("det_idx").alias("det_idx")).select(*place, "det_idx", "_who.*")
    take = {c: c for c in ("entity_id", "team_cluster", "court_x", "court_y")}
    return pairs.nearest_point_in_frame(balls, people, ["job_id", "frame_idx"], ["job_id", "frame_idx", "ts_ms"], ("ball_x", "ball_y"), ("court_x", "court_y"),
                                        cfg.control_radius, take, ["det_idx"]).withColumnRenamed("distance", "dist_ft")


def possessions(controls: DataFrame, cfg: Hoops = Hoops()) -> DataFrame:
    """WIN-01 on the controlling team."""
    r = islands.label_runs(controls, ["job_id"], ["ts_ms", "frame_idx"], "team_cluster", cfg.bridge, cfg.min_possession)
    return r.select("job_id", F.col("run_id").alias("possession_id"), F.col("team_cluster").alias("offense_team_cluster"),
                    F.col("start").alias("ts_start_ms"), F.col("end").alias("ts_end_ms"))


def atomic_events(controls: DataFrame, poss: DataFrame, cfg: Hoops = Hoops()) -> DataFrame:
    """WIN-05: control transitions with their possession, and both ends of each possession."""
    t = islands.transitions(controls, ["job_id"], ["ts_ms", "frame_idx"], "entity_id", "team_cluster", cfg.handoff)
    t = t.withColumn("_id", F.struct("job_id", "ts_ms", "frame_idx"))
    spans = poss.select("job_id", F.col("ts_start_ms").alias("_s"), F.col("ts_end_ms").alias("_e"), "possession_id")
    t = interval.first_containing(t, spans, ["job_id"], ["_id"], "ts_ms", "_s", "_e", ["possession_id"], ["possession_id"], 10_000)
    payload = F.when(F.col("from_actor").isNotNull(), F.to_json(F.struct(F.col("from_actor").alias("from_entity"), F.col("gap").alias("gap_ms"))))
    moves = t.select("job_id", F.col("kind").alias("event_type"), "ts_ms", "entity_id", "team_cluster", "court_x", "court_y", "possession_id", payload.alias("payload_json"))
    edge = F.explode(F.array(F.struct(F.lit("possession_start").alias("e"), F.col("ts_start_ms").alias("t")), F.struct(F.lit("possession_end").alias("e"), F.col("ts_end_ms").alias("t"))))
    ends = poss.select("*", edge.alias("_x")).select("job_id", F.col("_x.e").alias("event_type"), F.col("_x.t").alias("ts_ms"),
                                                    F.col("offense_team_cluster").alias("team_cluster"), "possession_id")
    both = moves.unionByName(ends, allowMissingColumns=True)
    return scan(both, ["job_id"], ["ts_ms", "event_type", "possession_id"], {"event_id": row_number()}).withColumn("event_id", F.col("event_id") - 1)


def contact_events(track: DataFrame, bodies: DataFrame, rims: DataFrame, hold_px: float = 30.0, break_rows: int = 6, hold_rows: int = 5,
                   merge_gap: int = 400, rise: float = 10.0, refractory: int = 1000, flight: tuple[int, int] = (250, 4000), scramble: int = 2500) -> DataFrame:
    """WIN-11: contacts, possessions, arrivals, shots and putbacks from a fused ball track.

    ``track``: job_id, frame, ts, seg, x, y, source; ``bodies``: job_id, frame, track_id, x1..y2; ``rims``:
    job_id, frame, x1..y2 (local references). Holder, velocity and run boundaries depend only on
    neighbouring rows of the segment, so they are joins and scans; the two refractory rules are folds.
    """
    box = tuple(F.col(c) for c in ("x1", "y1", "x2", "y2"))
    seg, order = ["job_id", "seg"], ["ts", "frame"]
    point = track.select("job_id", "frame", "x", "y", "source")
    near = pairs.nearest_in_frame(point.filter("source <> 'interp'"), bodies.withColumnRenamed("track_id", "body"), ["job_id", "frame"], ["job_id", "frame"],
                                  G.box_to_point(box, F.col("x"), F.col("y")), hold_px, {"holder": "body"}, ["body"]).select("job_id", "frame", "holder")

    def in_box(scale):
        return (F.abs(F.col("x") - (F.col("x1") + F.col("x2")) / 2) <= (F.col("x2") - F.col("x1")) * scale) & (
            F.abs(F.col("y") - (F.col("y1") + F.col("y2")) / 2) <= (F.col("y2") - F.col("y1")) * scale)

    rim = point.join(rims, ["job_id", "frame"]).groupBy("job_id", "frame").agg(F.max(in_box(2.0)).alias("at_rim"), F.max(in_box(1.0)).alias("in_rim"))
    d = track.join(near, ["job_id", "frame"], "left").join(rim, ["job_id", "frame"], "left")
    seen = F.when(F.col("source") != "interp", F.struct("frame", "y"))
    # the last four confirmed rows before (or at) each row give the incoming vertical speed
    d = scan(d, seg, order, {"_s0": fill_forward(seen, False), "_row": row_number()})
    conf = scan(d.filter("source <> 'interp'"), seg, order, {"_1": prev(F.struct("frame", "y"))})
    for i in (2, 3, 4):
        conf = scan(conf, seg, order, {f"_{i}": prev(F.col(f"_{i - 1}"))})

    def slope(newest: Column, oldest: Column) -> Column:
        return F.when(newest["frame"] > oldest["frame"], (newest["y"] - oldest["y"]) / (newest["frame"] - oldest["frame"]))

    here = F.struct("frame", "y")
    conf = conf.withColumn("_vin", slope(F.col("_1"), F.coalesce("_4", "_3", "_2"))).withColumn("_vnow", slope(here, F.coalesce("_3", "_2", "_1")))
    held = conf.filter("holder is not null")
    held = scan(held, seg, order, {"_p": prev(F.struct("holder", "_row"))})
    opens = F.col("_p").isNull() | (F.col("_p.holder") != F.col("holder")) | (F.col("_row") - F.col("_p._row") - 1 > break_rows)
    held = scan(held.withColumn("_o", opens.cast("int")), seg, order, {"run": running_sum(F.col("_o"))})
    runs = held.groupBy(*seg, "run").agg(
        F.first("holder").alias("track_id"), F.min("ts").alias("ts"), F.max("ts").alias("ts_end"), F.count(F.lit(1)).alias("n"), F.max("_row").alias("_last"),
        F.max_by(F.struct("x", "y"), "_row").alias("_xy"), F.min_by(F.coalesce("_vin", F.lit(0.0)), "_row").alias("_in"))
    runs = scan(runs, seg, ["run"], {"_next": next_(F.col("run"))})
    size = d.groupBy(*seg).agg(F.max("_row").alias("_rows"), F.max("ts").alias("_seg_end"))
    final = d.groupBy("job_id").agg(F.max_by("seg", F.struct("ts", "frame")).alias("_final"))
    runs = runs.join(size, seg).join(final, "job_id")
    # a contact still open when its segment is cut short never completes
    runs = runs.filter(F.col("_next").isNotNull() | (F.col("_rows") - F.col("_last") > break_rows) | (F.col("seg") == F.col("_final")))
    runs = runs.withColumn("graze", (F.col("n") < hold_rows) & (F.col("_in") <= -rise)).select(
        "job_id", "track_id", "ts", "ts_end", "n", F.col("_xy.x").alias("x"), F.col("_xy.y").alias("y"), "graze")
    long_runs = runs.filter(F.col("n") >= hold_rows)
    hold = scan(long_runs, ["job_id"], ["ts", "ts_end"], {"_p": prev(F.struct("track_id", "ts_end"))})
    same = (F.col("_p.track_id") == F.col("track_id")) & (F.col("ts") - F.col("_p.ts_end") <= merge_gap)
    hold = scan(hold.withColumn("_o", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)), ["job_id"], ["ts", "ts_end"], {"_g": running_sum(F.col("_o"))})
    poss = hold.groupBy("job_id", "_g").agg(F.first("track_id").alias("track_id"), F.min("ts").alias("ts"), F.max("ts_end").alias("ts_end"), F.max_by(F.struct("x", "y"), "ts").alias("_xy"))
    # arrivals: confirmed, nobody holding, at the rim, not rising unless inside the tight box
    free = scan(d, seg, order, {"_h": fill_forward(F.when(F.col("holder").isNotNull(), F.col("_row")))})
    free = free.filter("at_rim and source <> 'interp' and holder is null").filter(F.col("_h").isNull() | (F.col("_row") - F.col("_h") > break_rows))
    free = free.join(conf.select("job_id", "frame", "_vnow"), ["job_id", "frame"], "left")
    free = free.filter(~F.coalesce((F.col("_vnow") < -rise) & ~F.col("in_rim"), F.lit(False)))
    arrivals = folds.min_gap_sample(free.select("job_id", "ts", "frame", "x", "y"), ["job_id"], ["ts", "frame"], refractory, inclusive=False)
    ends = runs.filter("not graze").select("job_id", F.col("ts_end").alias("release_ts"), "track_id", F.col("x").alias("rx"), F.col("y").alias("ry"))
    shots = pairs.latest_alternate(arrivals.withColumn("_id", F.struct("job_id", "ts")), ends, ["job_id"], "_id", "ts", "release_ts", flight, ["release_ts", "track_id", "rx", "ry"]).filter("release_ts is not null")
    first = folds.min_gap_sample(shots.select("job_id", "ts"), ["job_id"], ["ts"], scramble, inclusive=False).withColumn("_first", F.lit(True))
    shots = shots.join(first, ["job_id", "ts"], "left")

    def rows(df, kind, x="x", y="y", **more):
        extra = [more.get(c, F.lit(None)).cast(t).alias(c) for c, t in (("ts_end", "long"), ("track_id", "long"), ("release_ts", "long"), ("n_frames", "long"))]
        return df.select("job_id", (kind if isinstance(kind, Column) else F.lit(kind)).alias("kind"), F.col("ts").cast("long").alias("ts"), F.col(x).alias("x"), F.col(y).alias("y"), *extra)

    p = poss.select("job_id", "track_id", "ts", "ts_end", "_xy.x", "_xy.y")
    return (
        rows(p, "hold", ts_end=F.col("ts_end"), track_id=F.col("track_id"))
        .unionByName(rows(p.withColumn("ts", F.col("ts_end")), "release", track_id=F.col("track_id")))
        .unionByName(rows(arrivals, "rim_arrival"))
        .unionByName(rows(runs, F.when(F.col("graze"), "contact_graze").otherwise("contact"), ts_end=F.col("ts_end"), track_id=F.col("track_id"), n_frames=F.col("n")))
        .unionByName(rows(shots, F.when(F.col("_first"), "shot").otherwise("putback"), "rx", "ry", track_id=F.col("track_id"), release_ts=F.col("release_ts"))))


def _displacement(people: DataFrame, shots: DataFrame, window: int) -> DataFrame:
    """Largest distance from the first to any other sample of ``who`` in the ``window`` before (or at) each shot.

    Samples and shots meet by entity and clock bucket (a sample in its own bucket and the next one) as sorted arrays, so no
    pair of them is written.
    """
    size = F.lit(window + 1)
    keys = ["job_id", "who", "_b"]
    here = F.floor(F.col("at") / size)
    left = people.withColumn("_b", F.explode(F.array(here, here + 1)))
    right = shots.withColumn("_b", here)
    out = T.StructType([*[shots.schema[c] for c in ("job_id", "who", "at")], T.StructField("max_disp", T.DoubleType())])

    def furthest(key: tuple, pts: pd.DataFrame, at: pd.DataFrame) -> pd.DataFrame:
        if not len(pts) or not len(at):
            return pd.DataFrame({f.name: [] for f in out.fields})
        pts = pts.sort_values(["at", "x", "y"], na_position="first")
        ts, x, y = pts["at"].to_numpy(), pts["x"].to_numpy(float), pts["y"].to_numpy(float)
        m = np.concatenate([[0], pts["_m"].to_numpy().cumsum()])
        when = at["at"].to_numpy()
        lo, hi = np.searchsorted(ts, when - window), np.searchsorted(ts, when, side="right")
        far = np.full(len(when), np.nan)
        for i in np.flatnonzero(m[hi] - m[lo] >= 2):
            dx, dy = x[lo[i]:hi[i]] - x[lo[i]], y[lo[i]:hi[i]] - y[lo[i]]
            far[i] = np.sqrt(np.fmax.reduce(dx * dx + dy * dy))
        return pd.DataFrame({"job_id": key[0], "who": key[1], "at": when, "max_disp": far})

    return spread(left, keys).groupBy(*keys).cogroup(spread(right, keys).groupBy(*keys)).applyInPandas(furthest, out)


def free_throws(shots: DataFrame, controls: DataFrame, pos: DataFrame, cfg: Hoops = Hoops(), window: int = 2500, radius: float = 5.0, still: float = 4.0, lineup: int = 3) -> DataFrame:
    """WIN-30: shooter near the line, standing still, and at least three others in the lane bands (one
    nearest sample per entity within 500 ms)."""
    c = controls.select("job_id", "ts_ms", F.col("entity_id").alias("shooter"), F.col("court_x").alias("sx"), F.col("court_y").alias("sy"), "frame_idx")
    s = asof.asof_join(shots.select("job_id", "event_id", "ts_start_ms", "court_end"), c, ["job_id"], "ts_start_ms", "ts_ms", {"shooter": "shooter", "sx": "sx", "sy": "sy"},
                       tolerance=cfg.shooter_lookback, tie=("frame_idx",))
    end = F.when(F.col("court_end").isin("left", "right"), F.col("court_end"))
    px = F.when(end == "left", G.FT_LINE).when(end == "right", G.COURT_LENGTH - G.FT_LINE)
    s = s.withColumn("dist_to_ft_point", G.dist(F.col("sx"), F.col("sy"), px, F.lit(G.RIM_Y)))
    # equal samples of an entity and equal shots count once, so repeated rows make no further pairs
    people = pos.filter("entity_id is not null").groupBy("job_id", F.col("entity_id").alias("who"), F.col("ts_ms").alias("at"), F.col("court_x").alias("x"), F.col("court_y").alias("y")).agg(
        F.count(F.lit(1)).alias("_m"))
    instants = s.select("job_id", F.col("ts_start_ms").alias("_at"), "shooter", "court_end").distinct()
    disp = _displacement(people, instants.filter("shooter is not null").select("job_id", F.col("shooter").alias("who"), F.col("_at").alias("at")).distinct(), window).select(
        "job_id", F.col("who").alias("shooter"), F.col("at").alias("ts_start_ms"), "max_disp")
    close = instants.select("*", (F.col("_at") - 500).alias("_lo"), (F.col("_at") + 500).alias("_hi"))
    others = interval.span_pairs(people, close, ["job_id"], "at", "_lo", "_hi", 1001, max_length=1001).filter(F.col("shooter").isNull() | (F.col("who") != F.col("shooter")))
    shot = ["job_id", "_at", "shooter", "court_end"]
    one = others.groupBy(*shot, "who").agg(F.min_by(F.struct("x", "y"), F.struct(F.abs(F.col("at") - F.col("_at")), "at", "x", "y")).alias("_p"))
    bx = G.baseline_x(F.col("_p.x"), F.col("court_end"))
    lane = F.col("court_end").isin("left", "right") & bx.between(0, G.FT_LINE) & F.abs(F.col("_p.y") - G.RIM_Y).between(5.5, 9.5)
    n = one.groupBy(*shot).agg(F.count_if(lane).alias("lane_lineup")).select("job_id", F.col("_at").alias("ts_start_ms"), F.struct("shooter", "court_end").alias("_who"), "lane_lineup")
    d = s.withColumn("_who", F.struct("shooter", "court_end")).join(disp, ["job_id", "shooter", "ts_start_ms"], "left")
    same = F.col("d.job_id").eqNullSafe(F.col("n.job_id")) & F.col("d.ts_start_ms").eqNullSafe(F.col("n.ts_start_ms")) & F.col("d._who").eqNullSafe(F.col("n._who"))
    d = d.alias("d").join(n.alias("n"), same, "left").select("d.*", F.coalesce("n.lane_lineup", F.lit(0)).alias("lane_lineup"))
    tests = [F.coalesce(F.col("dist_to_ft_point") <= radius, F.lit(False)), F.coalesce(F.col("max_disp") <= still, F.lit(False)), F.col("lane_lineup") >= lineup]
    hits = tests[0].cast("int") + tests[1].cast("int") + tests[2].cast("int")
    return d.select("job_id", "event_id", (hits == 3).alias("is_ft"), F.col("shooter").alias("shooter_entity"), "dist_to_ft_point", "max_disp", "lane_lineup", (hits / 3.0).alias("confidence"))


STATS = ("fga", "fgm", "fga3", "fgm3", "fta", "ftm", "ast", "oreb", "dreb", "points")


def box_events(shots: DataFrame, controls: DataFrame, names: DataFrame, ft: DataFrame | None = None, cfg: Hoops = Hoops()) -> DataFrame:
    """AGG-11: one row per credited stat: (job_id, team, player_key, entity_id, stat columns, conf).

    ``shots``: job_id, event_id, ts_start_ms, ts_end_ms, court_end, verdict_made, confidence; ``names``:
    job_id, entity_id, name. An attributed entity takes its own line (its name or ``e<id>``); a stat
    without an entity falls to the unattributed team line.
    """
    c = controls.select("job_id", "ts_ms", "frame_idx", "entity_id", "team_cluster", "court_x", "court_y")
    take = {"entity_id": "entity_id", "team": "team_cluster", "sx": "court_x", "sy": "court_y"}
    made = F.coalesce(F.col("verdict_made"), F.lit(False))
    s = shots.select("job_id", "event_id", "ts_start_ms", "ts_end_ms", "court_end", made.alias("made"), F.coalesce(F.col("confidence").cast("double"), F.lit(0.5)).alias("conf"))
    s = asof.asof_join(s, c, ["job_id"], "ts_start_ms", "ts_ms", take, tolerance=cfg.shooter_lookback, tie=("frame_idx",))
    if ft is not None:
        s = s.join(ft.select("job_id", "event_id", "is_ft"), ["job_id", "event_id"], "left")
    else:
        s = s.withColumn("is_ft", F.lit(False))
    s = s.withColumn("is_ft", F.coalesce("is_ft", F.lit(False)))
    three = F.coalesce(F.col("court_end").isin("left", "right") & G.is_three(F.col("sx"), F.col("sy"), F.col("court_end")), F.lit(False)) & ~F.col("is_ft")
    s = s.withColumn("three", three)
    m, fg = F.col("made").cast("long"), (~F.col("is_ft")).cast("long")
    t3, ftl = F.col("three").cast("long"), F.col("is_ft").cast("long")
    shot_rows = s.select("job_id", "entity_id", "team", fg.alias("fga"), (fg * m).alias("fgm"), t3.alias("fga3"), (t3 * m).alias("fgm3"), ftl.alias("fta"), (ftl * m).alias("ftm"),
                         F.when(F.col("made"), F.when(F.col("is_ft"), 1).when(F.col("three"), 3).otherwise(2)).otherwise(0).cast("long").alias("points"), "conf", F.col("ts_start_ms").alias("ts_ms"))
    good = s.filter("made and not is_ft and entity_id is not null").select("job_id", "event_id", F.col("ts_start_ms").alias("ts_ms"), "entity_id")
    ast = asof.assist(c.select("job_id", "ts_ms", "entity_id", "team_cluster"), good, ["job_id"], "ts_ms", "entity_id", "team_cluster", cfg.hold, cfg.handoff)
    ast = asof.asof_join(ast.filter("passer is not null").select("job_id", "passer", "pass_t", "ts_ms"), c, ["job_id"], "pass_t", "ts_ms", {"team": "team_cluster"}, tie=("frame_idx",))
    ast_rows = ast.select("job_id", F.col("passer").alias("entity_id"), "team", F.lit(1).cast("long").alias("ast"), F.lit(0.5).alias("conf"), "ts_ms")
    miss = s.filter("not made").select("job_id", "ts_end_ms", F.col("team").alias("shot_team"))
    reb = asof.asof_join(miss, c, ["job_id"], "ts_end_ms", "ts_ms", {"entity_id": "entity_id", "team": "team_cluster", "ts_ms": "ts_ms"}, "forward", cfg.rebound_ahead, False, ("frame_idx",)).filter("entity_id is not null")
    off = F.coalesce((F.col("team") == F.col("shot_team")) & (F.col("shot_team") >= 0), F.lit(False)).cast("long")
    reb_rows = reb.select("job_id", "entity_id", "team", off.alias("oreb"), (F.lit(1) - off).cast("long").alias("dreb"), F.lit(0.5).alias("conf"), "ts_ms")
    d = shot_rows.unionByName(ast_rows, allowMissingColumns=True).unionByName(reb_rows, allowMissingColumns=True).fillna(0, list(STATS))
    d = d.join(names.select("job_id", "entity_id", "name"), ["job_id", "entity_id"], "left")
    key = F.when(F.col("entity_id").isNull(), "team").otherwise(F.coalesce("name", F.concat(F.lit("e"), F.col("entity_id"))))
    return d.withColumn("player_key", key).withColumn("team", F.coalesce(F.col("team").cast("int"), F.lit(-1))).drop("name")


def box_score(events: DataFrame) -> DataFrame:
    """AGG-11: sums per line with the mean confidence."""
    from fieldtrace.operators.metrics import exact_mean
    return events.groupBy("job_id", "team", "player_key").agg(
        F.max_by("entity_id", "ts_ms").alias("entity_id"), *[F.sum(s).alias(s) for s in STATS], exact_mean(F.col("conf")).alias("confidence"))


def box_totals(box: DataFrame) -> DataFrame:
    """AGG-13: totals with two-point columns; lines without an entity stay apart as "unattributed"."""
    team = F.when(F.col("player_key") == "team", "unattributed").otherwise(F.concat(F.lit("team"), F.col("team")))
    g = box.groupBy("job_id", team.alias("bucket")).agg(*[F.sum(s).alias(s) for s in STATS])
    return g.withColumn("fga2", F.col("fga") - F.col("fga3")).withColumn("fgm2", F.col("fgm") - F.col("fgm3"))


def unnamed_labels(box: DataFrame) -> DataFrame:
    """AGG-13: "Player A", "Player B", ... for the unnamed lines of a team by stat weight."""
    weight = F.col("points") + F.col("fga") + F.col("fta") + F.col("ast") + F.col("oreb") + F.col("dreb")
    d = top_k(box.filter(F.col("player_key").startswith("e")), ["job_id", "team"], [weight.desc(), F.col("player_key")], 1 << 30, "_r")
    letter = F.char(F.lit(65) + F.pmod(F.col("_r") - 1, F.lit(26)))
    again = F.when(F.col("_r") > 26, F.floor((F.col("_r") - 1) / 26).cast("string")).otherwise("")
    return d.select("job_id", "team", "player_key", F.concat(F.lit("Player "), letter, again).alias("label"))


def truth_shots(plays: DataFrame, start_s: float = 0.0, end_s: float | None = None) -> DataFrame:
    """WIN-44: shooting plays of a segment on its own clock: field goals timed, free throws not; a miss
    scores nothing whatever its value."""
    d = plays.filter(F.col("shooting_play") & (F.col("video_t") >= start_s))
    if end_s is not None:
        d = d.filter(F.col("video_t") < end_s)
    ft, made = is_free_throw(F.col("type_text")), F.coalesce(F.col("scoring_play"), F.lit(False))
    t = F.col("video_t") - F.lit(start_s)
    return d.select("game_key", "play_id", ft.alias("free_throw"), F.when(~ft, F.rint(t * 1000).cast("long")).alias("ts_ms"), made.alias("made"),
                    F.when(made, F.coalesce("score_value", F.lit(0))).otherwise(0).alias("points"), F.col("shooter_jersey").try_cast("int").alias("jersey"))


def truth_box(plays: DataFrame) -> DataFrame:
    """WIN-44: game totals of the play list."""
    ft, made = is_free_throw(F.col("type_text")), F.coalesce(F.col("scoring_play"), F.lit(False))
    shot = F.col("shooting_play")
    return plays.groupBy("game_key").agg(F.count_if(shot & ~ft).alias("fga"), F.count_if(shot & ~ft & made).alias("fgm"), F.count_if(shot & ft).alias("fta"),
                                         F.count_if(shot & ft & made).alias("ftm"), F.count_if(F.lower(F.coalesce("text", F.lit(""))).contains("assist")).alias("ast"))


def play_payloads(spans: DataFrame, events: DataFrame, shots: DataFrame, span_id: str, slack: int = 2000, width: int = 10_000) -> DataFrame:
    """WIN-42: one JSON document per possession: participants, events inside, shots within ``slack``.

    A possession is seconds long, so its lists are small.
    """
    s = spans.select("job_id", span_id, "ts_start_ms", "ts_end_ms")
    inside = interval.span_pairs(events, s, ["job_id"], "ts_ms", "ts_start_ms", "ts_end_ms", width)
    ev = inside.groupBy("job_id", span_id).agg(
        F.array_sort(F.collect_list(F.struct("ts_ms", "event_type", "entity_id"))).alias("events"), F.array_sort(F.collect_set("entity_id")).alias("participants"))
    sh = interval.attach_in_slack(s, shots, ["job_id"], "ts_start_ms", "ts_end_ms", "shot_ts", slack, width)
    sh = sh.groupBy("job_id", span_id).agg(F.array_sort(F.collect_list(F.struct("shot_ts", "made"))).alias("shots"))
    d = spans.join(ev, ["job_id", span_id], "left").join(sh, ["job_id", span_id], "left")
    outcome = F.when(F.exists(F.coalesce("shots", F.array().cast("array<struct<shot_ts:bigint,made:boolean>>")), lambda x: x["made"]), "made").when(F.size("shots") > 0, "missed").otherwise("none")
    return d.select("job_id", span_id, outcome.alias("outcome"), F.to_json(F.struct(
        F.coalesce("participants", F.array().cast("array<bigint>")).alias("participants"), F.col("events"), F.col("shots"))).alias("payload_json"))
