"""Rows that tie in an order or lie far from the frame size."""

import datetime
import random

from pyspark.sql import functions as F

from fieldtrace.operators import islands, matching, pairs
from fieldtrace.plans import hoops, load_queries
from fieldtrace.sources import tracking

QUERIES = load_queries()[0]


def merged(spans, max_gap):
    out = []
    for s, e in sorted(spans):
        if out and s - out[-1][1] <= max_gap:
            out[-1][1] = max(out[-1][1], e)
            out[-1][2] += 1
        else:
            out.append([s, e, 1])
    return sorted(tuple(x) for x in out)


def test_equal_spans_open_one_union(spark, monkeypatch):
    rng = random.Random(3)
    spans = [(s, s + rng.randrange(3)) for s in (rng.randrange(0, 3000) for _ in range(400)) for _ in range(rng.randrange(1, 40))]
    plain = islands.scan
    calls = []

    def shuffled(df, keys, order, ops, hot_rows=None):
        """Rows in another order for each scan, as another shuffle brings them."""
        calls.append(order)
        return plain(df.orderBy(islands.F.xxhash64(*[c for c in ("s", "e", "row") if c in df.columns], islands.F.lit(len(calls)))).coalesce(1), keys, order, ops, hot_rows)

    monkeypatch.setattr(islands, "scan", shuffled)
    df = spark.createDataFrame([(1, i, s, e) for i, (s, e) in enumerate(spans)], "k long, row long, s long, e long")
    for hot in (None, 200):
        got = islands.merge_spans(df, ["k"], "s", "e", 1, hot)
        assert sorted((r["start"], r["end"], r["n"]) for r in got.collect()) == merged(spans, 1)


def test_clock_step_counts_equal_clocks(spark):
    df = spark.createDataFrame([(1, v) for v in (0, 0, 0, 10, 30)], "game long, us long")
    assert [tuple(r) for r in tracking.clock_step(df, ["game"], "us").collect()] == [(1, 4, 5.0)]


def test_skillcorner_keeps_the_first_of_a_tie(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    rows = [(n, at + datetime.timedelta(hours=n // 2), 1, "view", 0.01 + 0.04 * (n % 2 == 0), '{"k": 7}') for n in range(40)]
    spark.createDataFrame(rows[::-1], "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = QUERIES["src08_skillcorner"](spark, str(tmp_path)).first()
    assert (got["n"], got["unavailable"]) == (20, 20)


def test_nearest_value_like_all_pairs(spark):
    rng = random.Random(5)
    left = [(i, rng.randrange(3), rng.choice([None, rng.randrange(60)])) for i in range(300)]
    right = [(i, rng.randrange(2), rng.choice([None, rng.randrange(0, 60, 4)])) for i in range(60)]
    a, b = spark.createDataFrame(left, "id long, f long, v long"), spark.createDataFrame(right, "rid long, f long, rv long")
    want = []
    for i, f, v in left:
        near = min(((abs(v - rv), r) for r, g, rv in right if g == f and rv is not None), default=None) if v is not None else None
        if near and near[0] <= 2:
            want.append((i, f, v, near[1], near[0]))
    for hot in (None, 20):
        got = pairs.nearest_value_in_frame(a, b, ["f"], "v", "rv", 2, {"who": "rid"}, ["rid"], hot)
        assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString() or hot
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_crowded_frames_make_no_pairs(spark):
    met = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def gap(a, b):
        met.add(1)
        return float(abs(a - b))

    balls = spark.createDataFrame([(1, float(i)) for i in range(50)] + [(2, 5.0)], "f long, x double")
    players = spark.createDataFrame([(f, i % 2, float(i)) for f in (1, 2) for i in range(20)], "f long, team long, px double")
    got = sorted(tuple(r) for r in pairs.possession_by_frame(balls, players, ["f"], gap("x", "px"), "team", 5.0, 0.5, 4).collect())
    assert got == [(1, 50, None, None), (2, 1, 0.0, 1)] and met.value <= 40


def test_one_control_for_each_instant(spark):
    cols = "job_id long, frame_idx long, ts_ms long, det_idx long, cls int, entity_id long, team_cluster long, court_x double, court_y double, court_conf double"
    ball, person = hoops.BALL, hoops.PERSON
    once = [(1, 0, 5, 1, ball, None, None, 10.0, 10.0, 1.0), (1, 0, 6, 2, person, 7, 0, 12.0, 10.0, 1.0), (1, 0, 7, 3, person, 8, 1, 8.0, 10.0, 1.0)]
    rows = [(*r[:3], r[3] + 10 * i, *r[4:]) for i in range(4) for r in once]
    got = hoops.ball_controls(spark.createDataFrame(rows, cols), fill=False).select("job_id", "ts_ms", "entity_id", "dist_ft").collect()
    assert [tuple(r) for r in got] == [(1, 5, 7, 2.0)]


def test_components_are_folded_in_one_pass(spark):
    rng = random.Random(11)
    pairs_ = [(10 * c + i, 10 * c + j if rng.random() < 0.8 else None) for c in range(200) for i in range(3) for j in rng.sample(range(4), rng.randrange(1, 4))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # components go on over batches
    try:
        d = matching.eliminate(spark.createDataFrame(pairs_, "item long, target long"), "item", "target")
        plan = d._jdf.queryExecution().optimizedPlan().toString()
        got = {r["item"]: (r["status"], r["target"], r["free"]) for r in d.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    options = {i: sorted({t for k, t in pairs_ if k == i and t is not None}) for i, _ in pairs_}
    want, claimed, moved = {}, set(), True
    while moved:
        moved = False
        for i in sorted(set(options) - set(want)):
            free = [t for t in options[i] if t not in claimed]
            if len(free) == 1:
                claimed.add(free[0])
                want[i], moved = ("paired", free[0], 0), True
            elif not free:
                want[i] = ("no_match", None, 0)
    want |= {i: ("ambiguous", None, sum(t not in claimed for t in options[i])) for i in set(options) - set(want)}
    assert got == want and "FlatMapGroupsInPandas" not in plan
