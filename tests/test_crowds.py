"""Steps that must not list the pairs of a crowd: plain Python on small rows, and rows repeated so often that their pairs would not end."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from conftest import rows
from fieldtrace.operators import kernels, linking, matching, metrics
from fieldtrace.plans import hoops, load_queries

PEOPLE = "job_id int, entity_id int, ts_ms long, court_x double, court_y double"
SHOTS = "job_id int, event_id int, ts_start_ms long, court_end string"
CONTROLS = "job_id int, ts_ms long, frame_idx long, entity_id int, court_x double, court_y double"


def displacement(people, job, shooter, at, window):
    own = sorted((t, x, y) for j, e, t, x, y in people if j == job and e == shooter and at - window <= t <= at)
    return max(math.sqrt((x - own[0][1]) ** 2 + (y - own[0][2]) ** 2) for _, x, y in own) if len(own) >= 2 else None


def lineup(people, job, shooter, at, end):
    near = {}
    for j, e, t, x, y in people:
        if j == job and e != shooter and abs(t - at) <= 500:
            near[e] = min(near.get(e, ((1e9,),)), ((abs(t - at), t, x, y), x, y))
    return sum(0 <= (x if end == "left" else 94 - x) <= 19 and 5.5 <= abs(y - 25) <= 9.5 for _, x, y in near.values())


def test_free_throws_against_plain_python(spark):
    rnd = random.Random(5)
    people = [(rnd.randrange(2), rnd.randrange(5), rnd.randrange(6000), float(rnd.randrange(20)), float(rnd.randrange(15, 36))) for _ in range(400)]
    people += people[:40]
    controls = [(j, t, t, e, x, y) for j, e, t, x, y in people[:60]]
    shots = [(rnd.randrange(2), i, rnd.randrange(6000), rnd.choice(["left", "right", None])) for i in range(40)]
    shots += [(j, i + 100, t, end) for j, i, t, end in shots[:10]]
    got = hoops.free_throws(spark.createDataFrame(shots, SHOTS), spark.createDataFrame(controls, CONTROLS), spark.createDataFrame(people, PEOPLE), window=900).collect()
    assert len(got) == len(shots)
    at = {i: (t, end) for _, i, t, end in shots}
    for r in got:
        t, end = at[r.event_id]
        assert r.max_disp == displacement(people, r.job_id, r.shooter_entity, t, 900)
        assert r.lane_lineup == (lineup(people, r.job_id, r.shooter_entity, t, end) if end else 0)
    assert sum(r.max_disp is not None for r in got) > 10 and sum(r.lane_lineup > 0 for r in got) > 3


def test_free_throws_of_a_crowd(spark):
    n = 60_000  # 3.6 billion pairs of a shot and a sample
    ids = spark.range(n).select(F.lit(1).alias("job_id"), F.col("id").cast("int").alias("event_id"))
    shots = ids.select("job_id", "event_id", F.lit(1000).cast("long").alias("ts_start_ms"), F.lit("left").alias("court_end"))
    place = lambda e, t, x, y: (F.lit(e).alias("entity_id"), F.lit(t).cast("long").alias("ts_ms"), F.lit(x).alias("court_x"), F.lit(y).alias("court_y"))
    pos = ids.select("job_id", *place(1, 1000, 19.0, 25.0)).unionByName(spark.createDataFrame([(1, e, 900, 10.0, 32.0) for e in (2, 3, 4)] + [(1, 1, 990, 16.0, 21.0)], PEOPLE))
    controls = spark.createDataFrame([(1, 1000, 1, 1, 19.0, 25.0)], CONTROLS)
    got = hoops.free_throws(shots, controls, pos, radius=30.0, still=40.0).groupBy("is_ft", "max_disp", "lane_lineup").count()
    assert rows(got) == [(True, 5.0, 3, n)]


def test_nearest_in_gap_against_all_pairs(spark):
    rnd = random.Random(3)
    frags = [(rnd.randrange(2), i, rnd.randrange(-300, 300), rnd.randrange(12)) for i in range(400)]
    f = spark.createDataFrame(frags, "job long, id long, us long, k long")
    p = linking.gap_pairs(f, ["job"], "id", "us", "us", (1, 50)).filter(F.abs(F.col("a_k") - F.col("b_k")) <= 3)
    want = linking.mutual_best(p.select("job", "a_id", "b_id", (-F.abs(F.col("a_k") - F.col("b_k"))).alias("score")), ["job"], "a_id", "b_id", "score")
    got = linking.mutual_best(linking.nearest_in_gap(f, ["job"], "id", "us", "k", (1, 50), 3), ["job"], "a_id", "b_id", "score")
    assert rows(got.select(*want.columns)) == rows(want) and got.count() > 100


def test_fragments_of_a_crowd(spark):
    n = 60_000  # 3.6 billion pairs
    ids = spark.range(n).select(F.lit(1).cast("long").alias("job"), "id")
    f = ids.select("job", "id", F.lit(10).cast("long").alias("us"), F.lit(4).cast("long").alias("k")).unionByName(
        ids.select("job", F.col("id") + n, F.lit(20).cast("long").alias("us"), F.lit(5).cast("long").alias("k")).toDF("job", "id", "us", "k"))
    assert rows(linking.nearest_in_gap(f, ["job"], "id", "us", "k", (1, 50), 3)) == [(1, 0, n, -1)]


def test_robust_prior_sorts_the_rows_of_a_key_in_one_shuffle(spark, tmp_path, monkeypatch):
    rnd = random.Random(11)
    data = [(rnd.randrange(40), rnd.randrange(-500, 500) if rnd.random() > 0.05 else None) for _ in range(3000)] + [(None, 1), (77, None), (78, 5)]
    spark.createDataFrame(data, "key int, v long").repartition(3).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    monkeypatch.setattr(metrics, "SMALL_BYTES", 0)
    monkeypatch.setattr(metrics, "TASK_BYTES", 1000)
    out = metrics.robust_prior(df, ["key"], "v")
    groups = {}
    for k, v in data:
        if k is not None and v is not None:
            groups.setdefault(k, []).append(v)
    want = {k: (len(v), float(np.median(v)), float(np.median(np.abs(np.array(v) - np.median(v))))) for k, v in groups.items()}
    assert {r["key"]: (r.n, r.median, r.mad) for r in out.collect()} == want
    assert out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1


def test_many_small_groups_are_matched_without_a_call_each(spark):
    n = 40_000  # groups of two pairs of which the first takes the right end
    p = spark.range(2 * n).select(F.floor(F.col("id") / 2).alias("g"), (F.col("id") % 2).alias("l"), F.lit(7).cast("long").alias("r"), F.col("id").alias("o"))
    got = matching.greedy_match(p, ["g"], "l", "r", ["o"])
    assert "FlatMapGroups" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.agg(F.count("*"), F.count_distinct("g"), F.max("l")).first()[:] == (n, n, 0)


def control(balls, people, radius):
    best = {}
    for j, f, t, x, y in balls:
        for q, g, det, e, px, py in people:
            if (q, g) == (j, f) and None not in (px, py) and (d := math.sqrt((px - x) ** 2 + (py - y) ** 2)) <= radius:
                best[j, f, t] = min(best.get((j, f, t), (math.inf,)), (d, det, e))
    return sorted((*k, v[2], v[0]) for k, v in best.items())


POS = "job_id int, frame_idx long, ts_ms long, det_idx long, cls int, entity_id int, team_cluster int, court_x double, court_y double, court_conf double"


def test_controls_like_all_pairs(spark):
    """Equal distances, instants with several balls, frames without people or balls, frames over several batches."""
    rnd = random.Random(7)
    spot = lambda: (float(rnd.randrange(30)), float(rnd.randrange(30)))
    balls = [(rnd.randrange(2), rnd.randrange(6), rnd.randrange(40), *spot()) for _ in range(200)]
    people = [(rnd.randrange(2), rnd.randrange(1, 7), i, rnd.randrange(12), *(spot() if i % 50 else (None, 3.0))) for i in range(700)]
    rows_ = [(j, f, t, 1000 + i, hoops.BALL, None, None, x, y, 1.0) for i, (j, f, t, x, y) in enumerate(balls)]
    rows_ += [(j, f, 0, det, hoops.PERSON, e, e % 2, x, y, 1.0) for j, f, det, e, x, y in people]
    pos = spark.createDataFrame(rows_, POS)
    want = control(balls, people, 2.0)
    for size in ("10000", "37"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = hoops.ball_controls(pos, hoops.Hoops(control_radius=2.0), fill=False).select("job_id", "frame_idx", "ts_ms", "entity_id", "dist_ft")
            assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 50
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_nearest_points_in_blocks(monkeypatch):
    monkeypatch.setattr(kernels, "PAIRS", 50)
    rng = np.random.default_rng(4)
    px, py, x, y = rng.integers(0, 40, 300) / 2, rng.integers(0, 40, 300) / 2, rng.integers(0, 50, 120) / 2, rng.integers(0, 40, 120) / 2
    px = np.concatenate([np.sort(px[:200]), np.sort(px[200:])])
    lo, hi = np.repeat([0, 200, 300], 40), np.repeat([200, 300, 300], 40)
    rank = rng.permutation(300)
    hit, d = kernels.nearest_points(x, y, lo, hi, px, py, rank, 1.5)
    for i in range(120):
        all_ = [(math.sqrt((px[j] - x[i]) ** 2 + (py[j] - y[i]) ** 2), rank[j], j) for j in range(lo[i], hi[i])]
        best = min(all_, default=(math.inf, 0, -1))
        assert hit[i] == (best[2] if best[0] <= 1.5 else -1) and (hit[i] < 0 or d[i] == best[0])
    assert 20 < (hit >= 0).sum() < 80


def test_controls_of_a_crowd(spark):
    n = 100_000  # 10 billion pairs in one frame, all places apart
    at = spark.range(n).select(F.col("id").alias("i"))
    none = F.lit(None).cast("int")
    ball = at.select(F.lit(1).alias("job_id"), F.lit(0).cast("long").alias("frame_idx"), F.col("i").alias("ts_ms"), F.col("i").alias("det_idx"), F.lit(hoops.BALL).alias("cls"),
                     none.alias("entity_id"), none.alias("team_cluster"), (F.col("i") * 0.5).alias("court_x"), F.lit(0.0).alias("court_y"), F.lit(1.0).alias("court_conf"))
    person = ball.withColumn("cls", F.lit(hoops.PERSON)).withColumn("entity_id", (F.col("ts_ms") % 7).cast("int")).withColumn("court_x", F.col("court_x") + 0.125).withColumn("court_y", F.lit(3.0))
    got = hoops.ball_controls(ball.unionByName(person), fill=False)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "CartesianProduct" not in plan
    assert got.agg(F.count("*"), F.count_if(F.col("entity_id") == F.col("ts_ms") % 7), F.max("dist_ft")).first()[:] == (n, n, math.sqrt(9 + 0.125 ** 2))


def test_plans_read_kept_controls(spark, sf_dir):
    """The scans behind the controls read them; none makes them again."""
    plan = load_queries()[0]["hoops_events"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Scan ExistingRDD" in plan and "FileScan" not in plan
