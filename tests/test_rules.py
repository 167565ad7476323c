"""Literal cases of the sequential and sport rules."""

import pytest
from pyspark.sql import functions as F

from conftest import rows
from fieldtrace.operators import asof, folds, grid, interval, islands, metrics, pairs, quality, values, votes
from fieldtrace.operators.features import token_stream
from fieldtrace.plans import hoops, pitch
from fieldtrace.sources import tracking
from fieldtrace.streaming import rules


def test_controls_and_steal(spark):
    # an off-court player and an unlocated ball are left out
    loc = spark.createDataFrame(
        [("j", f, f * 100, d, c, t, x, y, 1.0) for f, d, c, t, x, y in [
            (1, 0, 0, 1, 20.0, 25.0), (1, 1, 0, 2, 60.0, 25.0), (1, 2, 1, None, 21.0, 25.0), (2, 0, 0, 1, 20.0, 25.0), (2, 1, 0, 2, 60.0, 25.0),
            (2, 2, 1, None, 59.0, 25.0), (3, 0, 0, 3, 200.0, 25.0), (3, 1, 1, None, None, None)]],
        "job_id string, frame_idx int, ts_ms bigint, det_idx int, cls int, track_id int, court_x double, court_y double, court_conf double")
    ent = spark.createDataFrame([("j", 1, 10, 0), ("j", 2, 20, 1), ("j", 3, 30, 0)], "job_id string, track_id int, entity_id int, team_cluster int")
    pos = hoops.positions(loc, ent)
    assert pos.filter("cls = 0").count() == 4 and pos.filter("cls = 1").count() == 2
    ctl = hoops.ball_controls(pos, fill=False)
    assert rows(ctl.select("ts_ms", "entity_id", "dist_ft")) == [(100, 10, 1.0), (200, 20, 1.0)]
    ev = hoops.atomic_events(ctl, hoops.possessions(ctl))
    assert rows(ev.select("ts_ms", "event_type")) == [(100, "control_gain"), (200, "steal_candidate")]


def test_window_merge(spark):
    d = spark.createDataFrame([("j", 1, 0, "left", 0., 0., 1., 1.), ("j", 2, 1000, None, 2., 0., 3., 1.), ("j", 3, 2000, "left", 0., 0., 1., 4.), ("j", 4, 2500, "right", 0., 0., 1., 1.),
                               ("j", 5, 6000, "right", 0., 0., 1., 1.)], "p string, frame int, ts int, court_end string, x1 double, y1 double, x2 double, y2 double")
    got = folds.merge_windows(d, ["p"])
    assert rows(got.select("ts_start", "ts_end", "court_end", "n_obs", "x2", "y2")) == [(0, 2000, "left", 3, 3.0, 4.0), (2500, 2500, "right", 1, 1.0, 1.0), (6000, 6000, "right", 1, 1.0, 1.0)]
    # no window outgrows its start
    chain = spark.createDataFrame([("j", i, i * 2000, "left", 0., 0., 1., 1.) for i in range(5)], d.schema)
    assert rows(folds.merge_windows(chain, ["p"]).select("ts_start", "n_obs")) == [(0, 4), (8000, 1)]


@pytest.mark.parametrize("name, controls, shot, expect", [
    ("catch and shoot", [(0, 1, 0), (1000, 2, 0)], (2000, 2), 1),
    ("opponent", [(0, 1, 1), (1000, 2, 0)], (2000, 2), None),
    ("long hold", [(0, 1, 0), (1000, 2, 0)], (5500, 2), None),
    ("slow handoff", [(0, 1, 0), (3000, 2, 0)], (3500, 2), None),
    ("first run", [(1000, 2, 0)], (2000, 2), None),
    ("other holder", [(0, 1, 0), (1000, 2, 0), (1500, 3, 0)], (2000, 2), None),
    ("dribbles", [(0, 1, 0), (1000, 2, 0), (1500, 2, 0), (1900, 2, 0)], (2000, 2), 1),
])
def test_assist(spark, name, controls, shot, expect):
    c = spark.createDataFrame([("j", *x) for x in controls], "p string, t int, e int, m int")
    s = spark.createDataFrame([("j", *shot)], "p string, t int, e int")
    assert asof.assist(c, s, ["p"], "t", "e", "m", 4000, 2000).first()["passer"] == expect, name


def test_team_runs_and_containment(spark):
    c = spark.createDataFrame([("j", 0, 500, 0), ("j", 1000, 1200, None), ("j", 2000, 2100, 0), ("j", 3000, 3100, 1), ("j", 9000, 9100, 1)], "p string, t0 int, t1 int, team int")
    r = folds.team_runs(c, ["p"], 4000)
    assert rows(r.select("t0", "t1", "team", "contacts")) == [(0, 2100, 0, 3), (3000, 3100, 1, 1), (9000, 9100, 1, 1)]
    spans = r.select("p", F.col("t0").alias("s"), F.col("t1").alias("e"), "team", F.col("t0").alias("sid"))
    pts = spark.createDataFrame([("j", 1, 100), ("j", 2, 2500), ("j", 3, -5), ("j", 4, 3050)], "p string, pid int, t int")
    got = interval.containing_else_last(pts, spans, ["p"], ["pid"], "t", "s", "e", "team", "sid", 1000)
    assert rows(got.select("pid", "team", "inside")) == [(1, 0, True), (2, 0, False), (3, None, False), (4, 1, True)]


def test_side_switch(spark):
    cols = "g int, t int, side string, team int"
    switch = [(1, i, s, m) for i, (s, m) in enumerate([("left", 0), ("right", 1)] * 3 + [("left", 1), ("right", 0)] * 3)]
    got = grid.change_point(spark.createDataFrame(switch, cols), ["g"], "t", "side", ("left", "right"), "team", 2, 2).first()
    assert (got["explained"], got["cut"]) == (12, 5)
    steady = [(1, i, s, m) for i, (s, m) in enumerate([("left", 0), ("right", 1)] * 5)]
    assert grid.change_point(spark.createDataFrame(steady, cols), ["g"], "t", "side", ("left", "right"), "team", 2, 2).count() == 0


def test_truth_builder(spark):
    p = spark.createDataFrame([("g", "1", "Jump Shot", True, True, 2, 1.0006, "12", "made, assist by A"), ("g", "2", "Three Point", True, False, 3, 5.0, None, ""), ("g", "3", "Free Throw - 1 of 2", True, True, 1, 7.0, "5", "")],
                              "game_key string, play_id string, type_text string, shooting_play boolean, scoring_play boolean, score_value int, video_t double, shooter_jersey string, text string")
    got = hoops.truth_shots(p)
    assert rows(got.select("play_id", "ts_ms", "points", "jersey")) == [("1", 1001, 2, 12), ("2", 5000, 0, None), ("3", None, 1, 5)]
    assert rows(hoops.truth_box(p)) == [("g", 2, 1, 1, 1, 1)]


def test_unnamed_lines_and_rebounds(spark):
    c = spark.createDataFrame([("j", 900, 9, 400, 0, 20.0, 25.0), ("j", 3000, 30, 500, 1, 30.0, 25.0)], "job_id string, ts_ms bigint, frame_idx int, entity_id int, team_cluster int, court_x double, court_y double")
    s = spark.createDataFrame([("j", 1, 1000, 2000, "left", False, 0.8)], "job_id string, event_id int, ts_start_ms bigint, ts_end_ms bigint, court_end string, verdict_made boolean, confidence double")
    names = spark.createDataFrame([], "job_id string, entity_id int, name string")
    box = {r["player_key"]: r for r in hoops.box_score(hoops.box_events(s, c, names)).collect()}
    assert set(box) == {"e400", "e500"} and box["e400"]["fga"] == 1 and box["e500"]["dreb"] == 1 and box["e500"]["oreb"] == 0
    labels = hoops.unnamed_labels(hoops.box_score(hoops.box_events(s, c, names)))
    assert rows(labels.select("player_key", "label")) == [("e400", "Player A"), ("e500", "Player A")]


def test_token_order_and_grid(spark):
    d = spark.createDataFrame([("g", 10, 1, 5), ("g", 150, 2, 5), ("g", 210, 3, 5)], "game string, t_ms int, seq int, entity_id int")
    assert [r["t_ms"] for r in grid.grid_sample(d, ["game", "entity_id"], ["t_ms"], 200).orderBy("t_ms").collect()] == [10, 210]
    clock = spark.createDataFrame([("g", 10, 9)], "game string, t_ms int, seq int")
    s = token_stream({"player": d, "clock": clock, "ball": None}, "game")
    assert [(r["channel"], r["token_idx"]) for r in s.orderBy("token_idx").collect()][:2] == [("clock", 0), ("player", 1)]
    with pytest.raises(ValueError):
        token_stream({"ball": None}, "game")


def test_calibration_edges(spark):
    d = spark.createDataFrame([(1.0, True), (1.0, True), (0.0, False)], "p double, y boolean")
    assert rows(metrics.reliability_bins(d, [], "p", F.col("y")).select("bin", "n")) == [(0, 1), (9, 2)]
    assert metrics.calibration_summary(d, [], "p", F.col("y")).first()["ece"] == 0.0
    steps = metrics.isotonic(d.withColumn("yi", F.col("y").cast("int")), [], "p", "yi")
    got = metrics.apply_steps(spark.createDataFrame([(0.0,), (0.5,), (2.0,)], "p double"), steps, [], "p")
    assert rows(got) == [(0.0, 0.0), (0.5, 1.0), (2.0, 1.0)]


def test_possession_intervals(spark):
    # starts 1, 6, 9 and ends 5, 9, 12
    ev = [(1.0, "PASS", 0), (3.0, "PASS", 0), (5.0, "BALL LOST", 0), (6.0, "RECOVERY", 1), (9.0, "SET PIECE", 1)]
    d = spark.createDataFrame([(1, t, i, 1, m, k, 12.0) for i, (t, k, m) in enumerate(ev)], "game int, t double, seq int, period int, team int, kind string, period_end double")
    got = folds.possession_intervals(d, ["game"])
    assert rows(got.select("possession", "start", "end", "end_reason")) == [(0, 1.0, 5.0, "BALL LOST"), (1, 6.0, 9.0, "restart"), (2, 9.0, 12.0, "recording_end")]
    zero = spark.createDataFrame([(1, 1.0, 0, 1, 0, "PASS", 5.0), (1, 1.0, 1, 1, 1, "PASS", 5.0), (1, 2.0, 2, 1, 1, "SHOT", 5.0)], d.schema)
    assert rows(folds.possession_intervals(zero, ["game"]).select("possession", "team", "start")) == [(0, 1, 1.0)]


def match_rows(flip=False):
    out = []
    for f in range(60):
        t = f * 0.2
        x = 40.0 + 2.5 * t
        for team in (0, 1):
            for i in range(8):
                px, py = 20.0 + 8 * i + (5 if team else 0), 5.0 + 7 * i
                out.append((1, 1, f, t, team, f"{team}-{i}", 105 - px if flip else px, py))
        out.append((1, 1, f, t, None, "ball", 105 - x if flip else x, 30.0))
    return out


TRACK = "game int, period int, frame int, time_s double, team int, player string, x_m double, y_m double"


def test_snapshots_ignore_the_future_and_the_direction(spark):
    tr = spark.createDataFrame(match_rows(), TRACK)
    d1 = spark.createDataFrame([(1, 1, 0, 1), (1, 1, 1, -1)], "game int, period int, team int, direction int")
    s = spark.createDataFrame([(1, 20, 0)], "game int, frame int, team int")
    a = pitch.snapshot_features(tr, d1, s).first()
    assert a["usable"] and abs(a["ball_forward_speed_mps"] - 2.5) < 1e-9 and a["observed_teammates"] == 8
    late = tr.withColumn("x_m", F.when(F.col("frame") > 20, 0.0).otherwise(F.col("x_m")))
    assert pitch.snapshot_features(late, d1, s).first() == a
    d2 = spark.createDataFrame([(1, 1, 0, -1), (1, 1, 1, 1)], d1.schema)
    b = pitch.snapshot_features(spark.createDataFrame(match_rows(True), TRACK), d2, s).first()
    assert all(abs(float(a[f]) - float(b[f])) < 1e-6 for f in pitch.FEATURES)
    assert not pitch.snapshot_features(tr, d1, spark.createDataFrame([(1, 0, 0)], s.schema)).first()["usable"]


def test_forward_label_bounds(spark):
    tr = spark.createDataFrame(match_rows(), TRACK)
    d = spark.createDataFrame([(1, 1, 0, 1), (1, 1, 1, -1)], "game int, period int, team int, direction int")
    s = spark.createDataFrame([(1, 10, 0, 12.0), (1, 10, 1, 12.0), (1, 11, 0, 4.0), (1, 59, 0, 12.0)], "game int, frame int, team int, end_s double")
    got = {(r["frame"], r["team"]): r["advances"] for r in pitch.forward_target(tr, d, s).collect()}
    # 2.5 m/s for exactly five seconds gains 12.5 m; a possession ending early does not
    assert got == {(10, 0): 1, (10, 1): 0, (11, 0): 0, (59, 0): None}
    holes = tr.withColumn("x_m", F.when((F.col("player") == "ball") & (F.col("frame") > 15), F.lit(None)).otherwise(F.col("x_m")))
    assert pitch.forward_target(holes, d, s.filter("frame = 10 and team = 0")).first()["advances"] is None


def test_skillcorner_status(spark):
    frames = spark.createDataFrame(
        [(1, 1, "00:00:01.0", [(7, 1.0, 2.0, True), (8, 3.0, 4.0, False)], (0.0, 0.0, 0.0, True)), (2, 1, "00:00:01.1", [], (None, None, None, None))], tracking.SKILLCORNER)
    playing = spark.createDataFrame([(7, "a", 0, 10), (8, "b", 0, 10), (9, "b", 5, 10)], "player_id bigint, team_id string, start_frame int, end_frame int")
    o = tracking.skillcorner_observations(frames, playing)
    assert rows(o.filter("entity = 'player'").select("frame", "provider_entity_id", "status")) == [(1, "7", "detected"), (1, "8", "extrapolated"), (2, "7", "unavailable"), (2, "8", "unavailable")]
    assert o.filter("frame = 2 and entity = 'ball'").first()["status"] == "unavailable"


def test_labels_stay_in_their_period(spark):
    a = spark.createDataFrame([(1, p, i, i, (i + p) % 2, p == 2 and i == 3, False) for p in (1, 2) for i in range(6)], "g int, period int, action_id int, t int, team_id int, goal boolean, own_goal boolean")
    got = values.action_labels(a, ["g", "period"], ["action_id"])
    assert got.filter("period = 1 and (scores or concedes)").count() == 0
    assert got.filter("period = 2 and scores").count() == 2 and got.filter("period = 2 and concedes").count() == 2


def test_association_keeps_ids_across_shots(spark):
    def frame(t, shot, xs, cls=0):
        return (1, t, shot, [(i, cls, x, 0.0, x + 10, 20.0, None) for i, x in enumerate(xs)])
    d = spark.createDataFrame([frame(0.0, 1, [0.0, 100.0]), frame(0.1, 1, [102.0, 2.0]), frame(0.2, 2, [2.0]), frame(0.3, 2, [2.0], 1)],
                              "seq int, t double, shot int, detections array<struct<id:int,cls:int,x1:double,y1:double,x2:double,y2:double,colour:array<double>>>")
    got = folds.fold(d, ["seq"], ["t"], rules.association_rule(), "id bigint, track_id bigint, t double")
    assert rows(got.select("t", "id", "track_id")) == [(0.0, 0, 1), (0.0, 1, 2), (0.1, 0, 2), (0.1, 1, 1), (0.2, 0, 3), (0.3, 0, 4)]


def test_absent_channel_is_skipped_not_clean(spark):
    f = spark.createDataFrame([("a", "checked"), ("a", "skipped"), ("b", "violation")], "rule string, outcome string")
    got = {r["rule"]: (r["status"], r["blocks"]) for r in quality.rule_status(f, ["a", "b", "c"], ["b"]).collect()}
    assert got == {"a": ("partial", False), "b": ("violations", True), "c": ("skipped", False)}


def test_track_identity(spark):
    def p(best, mass, illegible):
        v = [0.0] * 101
        v[best] = mass
        v[(best + 1) % 100] = 1.0 - mass - illegible
        v[100] = illegible
        return v
    d = spark.createDataFrame([(1, p(23, 0.9, 0.05), None)] * 3 + [(2, p(23, 0.5, 0.45), None)] + [(3, p(7, 0.6, 0.1), [8, 30])] * 4, "track int, p array<double>, lineup array<int>")
    got = {r["track"]: r for r in votes.track_identity(d.filter("track < 3"), ["track"], "p").collect()}
    assert got[1]["number"] == 23 and got[2]["number"] is None and got[2]["status"] == "insufficient_evidence"
    only = votes.track_identity(d.filter("track = 3"), ["track"], "p", "lineup").first()
    assert only["top_number"] == 8 and only["number"] == 8


def test_countdown_drops_lone_spikes(spark):
    clocks = [1200.0, 1190.0, 700.0, 690.0, 1195.0, 680.0, 670.0, 1200.0, 1199.0, 1198.0, 1190.0]
    d = spark.createDataFrame([(1, i, c) for i, c in enumerate(clocks)], "g int, t int, clock double")
    got = folds.countdown_timeline(d, ["g"]).orderBy("t").collect()
    assert [r["clock"] for r in got] == [1200.0, 1190.0, 700.0, 690.0, 680.0, 670.0, 1200.0, 1199.0, 1198.0, 1190.0]
    assert [r["period"] for r in got] == [1] * 6 + [2] * 4


def test_fusion_gates_and_bridges(spark):
    det = [(1, f, "det", 10.0 + 5 * f, 50.0, 0.9) for f in range(6)] + [(1, 3, "det", 900.0, 900.0, 0.99)]
    later = [(1, f, "heat", 10.0 + 5 * f, 50.0, 0.8) for f in range(30, 36)] + [(1, 60 + f, "det", 0.0, 0.0, 0.9) for f in (0, 1)]
    d = spark.createDataFrame(det + later, "g int, frame int, sensor string, x double, y double, conf double")
    t = folds.fuse_track(d, ["g"])
    assert sorted({r["seg"] for r in t.collect()}) == [0, 1]  # the far candidate and the two-row segment are gone
    assert t.filter("frame = 3").first()["x"] == 25.0
    b = folds.bridge_segments(t, ["g"])
    assert b.count() == 36 and b.filter("source = 'interp'").count() == 24 and b.select("chain").distinct().count() == 1


def test_contact_grammar(spark):
    # held by body 1 for six frames, flies for ten, arrives at the rim falling
    track = [(1, f, f * 40, 0, 100.0 + (0 if f < 6 else 20 * (f - 5)), 100.0 if f < 6 else (60.0 if f < 12 else 60.0 + 8 * (f - 12)), "det") for f in range(18)]
    tr = spark.createDataFrame(track, "job_id int, frame int, ts int, seg int, x double, y double, source string")
    bodies = spark.createDataFrame([(1, f, 1, 90.0, 60.0, 110.0, 160.0) for f in range(18)], "job_id int, frame int, track_id int, x1 double, y1 double, x2 double, y2 double")
    rims = spark.createDataFrame([(1, f, 310.0, 80.0, 350.0, 100.0) for f in range(18)], "job_id int, frame int, x1 double, y1 double, x2 double, y2 double")
    ev = hoops.contact_events(tr, bodies, rims)
    kinds = {r["kind"]: r for r in ev.collect()}
    assert set(kinds) == {"hold", "release", "contact", "rim_arrival", "shot"}
    assert kinds["shot"]["track_id"] == 1 and kinds["shot"]["release_ts"] == kinds["release"]["ts"]


def test_lock_sweep(spark):
    def seg(i, t0, t1, x, vec):
        return (1, i, float(t0), float(t1), 0, x, 0.0, float(t1), x, 0.0, 100.0, 0.0, 0.0, None if vec is None else [(1.0, vec)])
    d = spark.createDataFrame([seg(1, 0, 100, 0.0, [1.0, 0.0]), seg(2, 0, 100, 500.0, [0.0, 1.0]), seg(3, 200, 300, 5.0, None), seg(4, 5000, 5100, 900.0, [0.0, 1.0]), seg(5, 5000, 5100, 0.0, None)],
                              "g int, segment int, t0 double, t1 double, team int, fx double, fy double, t_last double, cx double, cy double, h double, vx double, vy double, gallery array<struct<q:double,v:array<double>>>")
    got = rows(folds.sweep_locks(d, ["g"]).select("segment", "lock", "how"))
    assert got == [(1, 0, "opened"), (2, 1, "opened"), (3, 0, "motion"), (4, 1, "appearance"), (5, None, "no_gallery")]


def test_a_long_lock_sweep_costs_no_more_per_segment(spark):
    import json
    import random
    import time

    rng = random.Random(5)
    cfg, unit = folds.Lock(), [[1.0 if i == j else 0.0 for j in range(8)] for i in range(8)]

    def plain(segments):
        """Every interval of every lock, as the rule says."""
        locks, out = [], []
        for r in segments:
            g, options = r["gallery"], []
            for i, lock in enumerate(locks):
                if lock["team"] != r["team"] or any(min(r["t1"], b) - max(r["t0"], a) > cfg.overlap for a, b in lock["spans"]):
                    continue
                gap = r["t0"] - lock["t_last"]
                motion = 0 < gap <= cfg.coast and abs(lock["cx"] + lock["vx"] * gap - r["fx"]) <= (cfg.gate_base + cfg.gate_grow * gap / 1000) * lock["h"]
                if g is None:
                    options += [(cfg.motion_score, 0.0, i, "motion")] if motion else []
                    continue
                sim = max(sum(a * b for a, b in zip(u, x["v"])) for u in lock["vectors"] for x in g)
                if sim >= (cfg.sim_motion if motion else cfg.sim):
                    options.append((sim + (cfg.bonus if motion else 0.0), sim, i, "motion+app" if motion else "appearance"))
            if g is None and len(options) != 1:
                out.append((r["segment"], None, "ambiguous" if options else "no_gallery"))
                continue
            last = {c: r[c] for c in ("t_last", "cx", "h", "vx")}
            _, _, i, how = max(options) if options else (0, 0, len(locks), "opened")
            if not options:
                locks.append({"team": r["team"], "spans": [], "vectors": [], **last})
            lock = locks[i]
            lock["spans"].append((r["t0"], r["t1"]))
            lock["vectors"] += [x["v"] for x in g or [] if x["v"] not in lock["vectors"]]
            if last["t_last"] >= lock["t_last"]:
                lock.update(last)
            out.append((r["segment"], i, how))
        return out

    def segments(n, step):
        t, out = 0.0, []
        for i in range(n):
            t += rng.choice([0, step])
            end, x = t + rng.choice([50, 400, 900]), float(rng.randrange(300))
            out.append({"segment": i, "t0": t, "t1": end, "team": rng.randrange(2), "fx": x, "fy": 0.0, "t_last": end, "cx": x + 5, "cy": 0.0, "h": 40.0, "vx": 0.01, "vy": 0.0,
                        "gallery": None if i % 6 == 0 else [{"q": rng.random(), "v": rng.choice(unit)}]})
        return out

    def swept(data, again=0):
        state, out = None, []
        for i, r in enumerate(data):
            if again and i % again == 0:
                state = json.loads(folds._dump(state))
            state, got = folds.lock_rule().step(state, r) if again else rule.step(state, r)
            out += [(x["segment"], x["lock"], x["how"]) for x in got]
        return out

    rule, data = folds.lock_rule(), segments(500, 120)
    want = plain(data)
    assert swept(data) == want and swept(data, 37) == want  # the state survives its JSON form
    assert {how for *_, how in want} == {"opened", "appearance", "motion", "motion+app", "ambiguous", "no_gallery"}
    long, t0 = segments(30_000, 300), time.time()
    swept(long)
    assert time.time() - t0 < 30  # every interval of every lock: minutes


def test_offset_band_and_inheritance(spark):
    ball = spark.createDataFrame([(1, 100, 5.0)], "j int, frame int, x double").withColumn("bid", F.lit(1))
    rim = spark.createDataFrame([(1, 98, 5.0, "a"), (1, 108, 5.0, "b")], "j int, rframe int, rx double, rim string")
    got = pairs.offset_band(ball, rim, ["j"], ["bid"], "frame", "rframe", 5, F.abs(F.col("x") - F.col("rx")) < 1, ["rim"], ["rim"])
    assert rows(got.select("rim", "offset")) == [("a", -2)]
    assert pairs.offset_band(ball, rim.filter("rim = 'b'"), ["j"], ["bid"], "frame", "rframe", 5, F.lit(True), ["rim"], ["rim"]).count() == 0
    r = spark.createDataFrame([(1, 1, 0, 0.0, "left"), (1, 2, 100, 10.0, None), (1, 3, 190, 0.0, "right"), (1, 4, 900, 0.0, None)], "j int, id int, frame int, x double, label string")
    got = pairs.inherit_label(r, ["j"], ["id"], "frame", "label", 300, F.abs(F.col("x") - F.col("s_x")) <= 50)
    assert rows(got.select("id", "label", "inherited")) == [(1, "left", False), (2, "right", True), (3, "right", False), (4, None, False)]


def test_interpolation_and_downsample(spark):
    d = spark.createDataFrame([(1, 0, 0, 0.0), (1, 600, 6, 6.0), (1, 3000, 30, 9.0)], "j int, t bigint, f bigint, x double")
    got = grid.interpolate_gaps(d, ["j"], "t", "f", ["x"], 150, 1500)
    assert {tuple(r) for r in got.select("t", "interpolated").collect()} == {(0, False), (150, True), (300, True), (450, True), (600, False), (3000, False)}
    s = spark.createDataFrame([(1, t) for t in (0, 100, 249, 250, 400, 501)], "j int, t int")
    assert rows(folds.min_gap_sample(s, ["j"], ["t"], 250)) == [(1, 0), (1, 250), (1, 501)]


def test_live_and_dead_spans(spark):
    r = spark.createDataFrame([(1, t) for t in (0, 5, 9, 30, 60, 64)], "g int, t int")
    live = islands.live_spans(r, ["g"], "t", 8)
    assert rows(live.select("start", "end")) == [(0, 9), (60, 64)]
    dead = islands.complement_spans(live, ["g"], spark.createDataFrame([(1, 0, 100)], "g int, lo int, hi int"), 1, 1)
    assert rows(dead.select("start", "end")) == [(10, 59), (65, 100)]


def test_seekers_coast_and_agree(spark):
    from fieldtrace.operators.seekers import bidirectional
    # two bodies walk in parallel; one is unseen for three frames; a flicker never confirms
    box = lambda f, det, x, y: (1, f * 40, f, det, x, y, x + 40.0, y + 100.0)
    d = [box(f, 0, 10.0 + 2 * f, 0.0) for f in range(20) if not 8 <= f <= 10] + [box(f, 1, 300.0 - 2 * f, 0.0) for f in range(20)] + [box(5, 2, 600.0, 0.0)]
    df = spark.createDataFrame(d, "g int, t int, frame int, det int, x1 double, y1 double, x2 double, y2 double")
    got = bidirectional(df, ["g"])
    assert got.select("seeker").distinct().count() == 2
    assert got.count() == 40 and got.filter("coasted").count() == 3 and got.filter("disputed").count() == 0
    assert got.filter("coasted and frame = 9").first()["x1"] == 28.0


def test_chains_must_move(spark):
    still = [(1, 0.1 * i, 100.0 + i % 2, 50.0, i) for i in range(5)]
    flight = [(1, 0.1 * i, 200.0 + 30 * i, 50.0, 10 + i) for i in range(4)]
    bounce = [(1, 0.1 * i, 400.0, 50.0 + 10 * (i % 3), 20 + i) for i in range(4)]
    d = spark.createDataFrame(still + flight + bounce, "g int, t double, x double, y double, id int")
    c = folds.chain_candidates(d, ["g"], 0.65, 90.0)
    near = spark.createDataFrame([(20,), (21,)], "id int")
    kept = folds.believed_chains(c, ["g"], near, 3, 45.0, 16.0)
    assert {r["id"] for r in kept.collect()} == {10, 11, 12, 13, 20, 21, 22, 23}


def test_rounding_goes_by_the_binary_value(spark):
    import random

    from fieldtrace.functions.decide import round_binary

    rng = random.Random(3)
    values = [2.675, 2.5, 0.125, 1.005, -2.675, 0.0, 1e15 + 0.3, 0.5, 1.5] + [rng.randrange(-10**6, 10**6) / 1000 for _ in range(500)] + [rng.uniform(-100, 100) for _ in range(500)]
    d = spark.createDataFrame([(v,) for v in values], "v double")
    for r in d.select("v", round_binary(F.col("v"), 2).alias("a"), round_binary(F.col("v"), 1).alias("b"), round_binary(F.col("v"), 4).alias("c")).collect():
        assert (r["a"], r["b"], r["c"]) == (round(r["v"], 2), round(r["v"], 1), round(r["v"], 4)), r["v"]


def test_seekers_of_a_crowded_frame():
    """Costs of all seekers and boxes of a frame at once (before: a Python step for each pair)."""
    import time

    from fieldtrace.operators.seekers import seeker_rule
    rule, state, out, t0 = seeker_rule(), None, [], time.time()
    for f in range(12):
        boxes = [{"det": i, "x1": 400.0 * i + f, "y1": 0.0, "x2": 400.0 * i + f + 40, "y2": 100.0} for i in range(600)]
        state, got = rule.step(state, {"t": 40 * f, "frame": f, "boxes": boxes})
        out += got
    assert len(out) == 12 * 600 and not any(r["contested"] or r["coasted"] for r in out)
    assert all(r["seeker"] == r["det"] + 1 for r in out)
    assert time.time() - t0 < 8


def test_a_fold_calls_python_for_partitions_not_for_keys(spark):
    """Many keys in one task: each keeps its own state, nulls and NaN are keys, and missing numbers arrive as None."""
    data = [(None if i % 50 == 0 else float("nan") if i % 50 == 1 else float(i % 50), t, None if (i + t) % 3 else t) for i in range(50) for t in range(4)]
    d = spark.createDataFrame(data, "j double, t int, v int")
    seen = folds.Rule(lambda state, r: ((state or []) + [r["v"]], []), lambda state: [{"n": len(state), "none": state.count(None), "kinds": len({type(v) for v in state})}])
    got = folds.fold(d, ["j"], ["t"], seen, "n int, none int, kinds int")
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().toString()
    assert sorted((str(r["j"]), r["n"]) for r in got.collect()) == sorted((str(j), 4) for j in {str(x[0]): x[0] for x in data}.values())
    assert sum(r["none"] for r in got.collect()) == sum(x[2] is None for x in data)
