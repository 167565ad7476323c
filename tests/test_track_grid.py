"""WIN-16 on a few tokens: every column against plain Python, and empty bins that no shuffle carries."""

import math
import random

from fieldtrace.operators import features

TOKENS = "game int, t_ms long, token_idx long, channel string, entity_id long, track_id long, court_x double, court_y double, value double, conf double, text string"
COLUMNS = ("game", "entity_id", "bin", "present", "x", "y", "dx", "dy", "conf", "ball_distance", "control_distance", "neighbour_distance", "read", "read_value", "read_conf", "last_read", "read_age")


def tokens(seed=3, n=260):
    rnd = random.Random(seed)
    kinds = ["player", "player", "ball", "ball_control", "jersey_read", "pbp_anchor"]
    return [(rnd.randrange(2), rnd.randrange(0, 4000), i, rnd.choice(kinds), rnd.randrange(4), rnd.randrange(4), float(rnd.randrange(94)), float(rnd.randrange(50)), float(rnd.randrange(12)),
             rnd.randrange(100) / 100, rnd.choice(["7", "no 12", "123", "x"])) for i in range(n)]


def plain(data, tracks, width, cap):
    top, cell, ball = {}, {}, {}
    for g, t, i, ch, e, tr, x, y, v, c, text in data:
        b = t // width
        if ch == "pbp_anchor":
            continue
        top[g] = max(top.get(g, 0), b)
        if ch == "ball":
            ball[g, b] = (x, y)
        k = cell.setdefault((g, tr if ch == "jersey_read" else e, b), {})
        if ch == "player":
            k["xy"], k["conf"] = (x, y), max(k.get("conf", 0.0), c)
        elif ch == "ball_control":
            k["control"] = min((v or 10.0) / 10.0, 1.0)
        elif ch == "jersey_read":
            number = "".join(d for d in text if d.isdigit())
            if number and int(number) <= 99:
                k["read"] = (int(number) / 99.0, c)
    for g, e in tracks:
        last, before = None, {}
        for b in range(top[g] + 1):
            k = cell.get((g, e, b), {})
            xy, p, bl = k.get("xy"), before.get("xy"), ball.get((g, b))
            near = [math.dist(xy, cell[g, o, b]["xy"]) for h, o in tracks if xy and h == g and o != e and "xy" in cell.get((g, o, b), {})]
            move = [max(-1.0, min(1.0, (a - z) / 10.0)) for a, z in zip(xy, p)] if xy and p else [0.0, 0.0]
            last = (b, k["read"][0]) if "read" in k else last
            yield (g, e, b, float(xy is not None), *((xy[0] / 94.0, xy[1] / 50.0) if xy else (0.0, 0.0)), *move, k.get("conf", 0.0), min(math.dist(xy, bl) / 10.0, 1.0) if xy and bl else 0.0,
                   k.get("control", 0.0), min(min(near) / 10.0, 1.0) if near else 0.0, float("read" in k), *k.get("read", (0.0, 0.0)), last[1] if last else 0.0, min((b - last[0]) / cap, 1.0) if last else 1.0)
            before = k


def test_track_grid_against_plain_python(spark):
    data, tracks = tokens(), [(0, 0), (0, 1), (0, 3), (1, 1), (1, 2), (1, 9)]  # track 9 has no token
    got = features.track_grid(spark.createDataFrame(data, TOKENS), spark.createDataFrame(tracks, "game int, entity_id long"), "game", 50, 30)
    got = {tuple(r)[:3]: tuple(r)[3:] for r in got.select(*COLUMNS).collect()}
    want = {r[:3]: r[3:] for r in plain(data, tracks, 50, 30.0)}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert all(math.isclose(a, b, abs_tol=1e-12) for a, b in zip(got[k], v)), (k, got[k], v)


def test_empty_bins_are_not_shuffled(spark):
    d = features.track_grid(spark.createDataFrame(tokens(), TOKENS), spark.createDataFrame([(0, 0)], "game int, entity_id long"), "game", 50)
    plan = d._jdf.queryExecution().sparkPlan().toString().splitlines()
    at = next(i for i, x in enumerate(plan) if "Generate explode" in x)
    assert not any(op in x for x in plan[:at] for op in ("Join", "Window", "Aggregate"))
