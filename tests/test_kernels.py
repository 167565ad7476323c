"""Kernels and joins against brute force."""

import itertools
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from conftest import rows
from fieldtrace.operators import linking, matching, reports
from fieldtrace.operators.kernels import assign, diameter, pav


def test_assignment_is_optimal():
    rng = np.random.default_rng(3)
    for n, m in [(1, 1), (2, 4), (4, 2), (4, 4), (5, 3)]:
        cost = rng.random((n, m))
        got = sum(cost[a, b] for a, b in assign(cost))
        small, big = (n, m) if n <= m else (m, n)
        c = cost if n <= m else cost.T
        best = min(sum(c[i, p[i]] for i in range(small)) for p in itertools.permutations(range(big), small))
        assert abs(got - best) < 1e-9


def test_pooling_in_slices_equals_pooling_at_once():
    rng = random.Random(5)
    pts = pd.DataFrame({"score_to": np.arange(60) / 60.0, "n": [rng.randint(1, 4) for _ in range(60)]})
    pts["s"] = [float(rng.randint(0, n)) for n in pts["n"]]
    whole = pav(pts, ["score_to", "n", "s"])
    parts = pd.concat([pav(pts.iloc[i:i + 13], ["score_to", "n", "s"]) for i in range(0, 60, 13)])
    again = pav(parts, ["score_to", "n", "s"])
    assert whole.values.tolist() == again.values.tolist()
    means = (whole["s"] / whole["n"]).tolist()
    assert means == sorted(means)


def test_diameter():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 40):
        p = rng.integers(0, 30, size=(n, 2)).astype(float)
        want = max(float(np.hypot(*(a - b))) for a in p for b in p)
        assert abs(diameter(p) - want) < 1e-9
    line = np.array([[i, 2.0 * i] for i in range(9)], dtype=float)
    assert abs(diameter(line) - float(np.hypot(8, 16))) < 1e-9


def test_retrieval_is_exact(spark):
    rng = np.random.default_rng(1)
    c = rng.normal(size=(300, 6))
    c[100:200] = c[0]  # a third are copies
    q = rng.normal(size=(40, 6))
    cd = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "cid int, v array<double>")
    qd = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "qid int, v array<double>")
    got = {}
    for r in linking.retrieve(cd, qd, "cid", "qid", "v", 5, pivots=8, block=32).collect():
        got.setdefault(r["qid"], {})[r["rank"]] = r["cid"]
    for i, v in enumerate(q):
        d = np.sqrt(((c - v) ** 2).sum(axis=1))
        assert [got[i][k + 1] for k in range(5)] == sorted(range(300), key=lambda j: (d[j], j))[:5]


def test_components_and_veto(spark):
    nodes = spark.createDataFrame([(1, i) for i in range(1, 10)], "job int, id int")
    edges = spark.createDataFrame([(1, 5, 4), (1, 4, 3), (1, 3, 2), (1, 8, 9)], "job int, a int, b int")
    assert rows(linking.components(nodes, edges, ["job"], "id", "a", "b").select("id", "root")) == [
        (1, 1), (2, 2), (3, 2), (4, 2), (5, 2), (6, 6), (7, 7), (8, 8), (9, 8)]
    pairs = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 3, 4)], "job int, a int, b int")
    labels = spark.createDataFrame([(1, 1, "7"), (1, 3, "9"), (1, 4, "9")], "job int, id int, label string")
    # 2 carries 7 through its union with 1, so it may not join 3
    assert rows(linking.vetoed_union(pairs, labels, ["job"], "a", "b", "id", "label").select("a", "b")) == [(1, 2), (3, 4)]


def test_mutual_best_needs_both_sides(spark):
    p = spark.createDataFrame([(1, 1, 10, 0.9), (1, 2, 10, 0.95), (1, 1, 11, 0.5), (1, 3, 12, 0.7)], "j int, a int, b int, s double")
    assert rows(linking.mutual_best(p, ["j"], "a", "b", "s").select("a", "b")) == [(2, 10), (3, 12)]


def test_elimination_reaches_the_fixpoint(spark):
    c = spark.createDataFrame([("b", "x"), ("a", "x"), ("a", "y"), ("c", "y"), ("c", "z"), ("d", None), ("e", "p"), ("e", "q")], "item string, target string")
    got = {r["item"]: (r["status"], r["target"]) for r in matching.eliminate(c, "item", "target").collect()}
    # a waits, b claims x, c waits; then a claims y, c claims z
    assert got == {"a": ("paired", "y"), "b": ("paired", "x"), "c": ("paired", "z"), "d": ("no_match", None), "e": ("ambiguous", None)}


def test_optimal_beats_greedy(spark):
    p = spark.createDataFrame([(1, "a", "x", 0.9), (1, "a", "y", 0.8), (1, "b", "x", 0.8)], "f int, l string, r string, s double")
    assert rows(matching.optimal_match(p, ["f"], "l", "r", "s").select("l", "r")) == [("a", "y"), ("b", "x")]
    g = p.withColumn("o", -F.col("s"))
    assert rows(matching.greedy_match(g, ["f"], "l", "r", ["o"]).select("l", "r")) == [("a", "x")]


def test_duplicates_fall_to_the_best_box(spark):
    b = spark.createDataFrame([(1, "p", 0.9, 1, 0., 0., 10., 10.), (1, "p", 0.8, 2, 1., 1., 11., 11.), (1, "p", 0.7, 3, 50., 0., 60., 10.), (1, "q", 0.6, 4, 0., 0., 10., 10.)],
                              "f int, label string, score double, id int, x1 double, y1 double, x2 double, y2 double")
    assert rows(matching.suppress_duplicates(b, ["f"], "label", "score", "id", 0.5).select("id")) == [(1,), (3,), (4,)]


def test_perfect_tracking_scores_one(spark):
    t = spark.createDataFrame([(1, f, g, 10.0 * g, 0.0, 10.0 * g + 8, 8.0) for f in range(5) for g in range(3)], "seq int, frame int, gt int, x1 double, y1 double, x2 double, y2 double")
    same = t.withColumnRenamed("gt", "tr")
    r = reports.tracking_scores(t, same, ["seq"], "frame", [0.05 * i for i in range(1, 20)]).first()
    assert all(abs(r[k] - 1.0) < 1e-9 for k in ("hota", "det_a", "ass_a", "loc_a", "idf1"))
    # halves with swapped ids: every box found, association worse
    swapped = same.withColumn("tr", F.when(F.col("frame") >= 3, (F.col("tr") + 1) % 3).otherwise(F.col("tr")))
    r = reports.tracking_scores(t, swapped, ["seq"], "frame", [0.5]).first()
    assert r["det_a"] == 1.0 and r["ass_a"] < 1.0 and abs(r["idf1"] - 0.6) < 1e-9


def test_missing_frames_stay_in_the_denominator(spark):
    cols = "seq string, frame int, label string, {} int, {} x1 double, y1 double, x2 double, y2 double"
    truth = spark.createDataFrame([("s", 1, "p", 1, False, 0., 0., 10., 10.), ("s", 2, "p", 2, False, 0., 0., 10., 10.), ("s", 1, "p", 3, True, 50., 50., 60., 60.)], cols.format("truth_id", "ignored boolean,"))
    pred = spark.createDataFrame([("s", 1, "p", 1, 0.9, 0., 0., 10., 10.), ("s", 1, "p", 2, 0.8, 1., 0., 11., 10.), ("s", 1, "p", 3, 0.7, 50., 50., 60., 60.)], cols.format("pred_id", "score double,"))
    manifest = spark.createDataFrame([("s", 1), ("s", 2), ("s", 3)], "seq string, frame int")
    r = reports.detection_counts(pred, truth, manifest, ["seq", "frame"], "label", 0.5, ["seq"]).filter("label is null and seq is null").first()
    assert (r["frames"], r["tp"], r["fp"], r["fn"], r["ignored"]) == (3, 1, 1, 1, 1)


def test_parabola_survives_an_outlier(spark):
    pts = [(1, i / 10, 2.0 * (i / 10) ** 2 - 3.0 * (i / 10) + 1.0, 1.0) for i in range(12)] + [(1, 0.55, 1.5, 1.0)]
    d = spark.createDataFrame(pts, "g int, t double, y double, w double")
    r = reports.quadratic_flight(d, ["g"], "t", "y", "w", 3, 0.6, 6).first()
    assert r["inliers"] == 12 and abs(r["a"] - 2.0) < 1e-4 and abs(r["c"] - 1.0) < 1e-4


def test_best_flight_like_least_squares(spark):
    rng = np.random.default_rng(5)
    rows_ = []
    for g in range(3):
        t = np.arange(0, 1.3, 0.05)
        x, y = 8 - 6 * t - 0.1 * (t - 1.2) ** 2, 20 * (1.2 - t) - 9 * (1.2 - t) ** 2
        x, y = x - x[24] + rng.normal(0, 0.05, len(t)), y + rng.normal(0, 0.05, len(t))
        y[5] += 15  # a stray peak
        rows_ += [(g, float(a), float(b), float(c), float(s)) for a, b, c, s in zip(t, x, y, rng.uniform(0.3, 1, len(t)))]
    d = spark.createDataFrame(rows_, "g int, t double, x double, y double, score double")
    near = F.hypot("x", "y") <= 1.5
    got = {r["g"]: r for r in reports.best_flights(d, ["g"], near, gate=2.0).collect()}

    def fit(p, arrive):
        p = p[(p[:, 0] <= arrive + 0.05) & (p[:, 0] >= arrive - 1.6)]
        keep = np.ones(len(p), bool)
        for _ in range(3):
            basis = np.stack([np.ones(len(p)), p[:, 0] - arrive, (p[:, 0] - arrive) ** 2], 1)
            w = p[:, 3] * keep
            cx, cy = (np.linalg.lstsq(basis * w[:, None], p[:, k] * w, rcond=None)[0] for k in (1, 2))
            keep = np.hypot(basis @ cx - p[:, 1], basis @ cy - p[:, 2]) <= 2.0
        return p[keep, 3].sum(), int(keep.sum()), p[keep, 0].min(), np.hypot(cx[0], cy[0])

    for g in range(3):
        p = np.array([r[1:] for r in rows_ if r[0] == g])
        tries = [(fit(p, a), a) for a in p[np.hypot(p[:, 1], p[:, 2]) <= 1.5, 0][:8]]
        (energy, n, launch, _), arrive = max((f for f in tries if f[0][3] <= 2.0), key=lambda f: (f[0][0], -f[1]))
        r = got[g]
        assert (r["n_inliers"], r["t_launch"], r["t_arr"]) == (n, launch, arrive) and abs(r["energy"] - energy) < 1e-9


def test_table_function(spark):
    reports.register_expand(spark)
    assert rows(spark.sql("select * from expand_span(0, 10, 5)")) == [(0, 0.0), (5, 0.5)]


def test_team_clusters(spark):
    from fieldtrace.ml.models import team_clusters
    pts = [(1, i, [float(10 * (i % 3)) + 0.01 * i, 0.0]) for i in range(10)] + [(2, i, [1.0, 1.0]) for i in range(4)]
    got = {(r["job"], r["id"]): r["cluster"] for r in team_clusters(spark.createDataFrame(pts, "job int, id int, v array<double>"), ["job"], "id", "v", rounds=3).collect()}
    assert {got[(1, i)] for i in (0, 3, 6, 9)} == {0} and len({got[(1, i)] for i in (1, 4, 7)}) == 1 and {got[(2, i)] for i in range(4)} == {-1}


def test_identity_follows_the_largest_total(spark):
    """A long-lived pair is not given up for two stray ones."""
    box = (0.0, 0.0, 10.0, 10.0)
    t = spark.createDataFrame([("s", f, "A", *box) for f in range(101)] + [("s", 200, "B", *box)], "seq string, frame int, gt string, x1 double, y1 double, x2 double, y2 double")
    p = spark.createDataFrame([("s", f, "X", *box) for f in range(100)] + [("s", 100, "Y", *box), ("s", 200, "X", *box)], "seq string, frame int, tr string, x1 double, y1 double, x2 double, y2 double")
    r = reports.tracking_scores(t, p, ["seq"], "frame", [0.5]).first()
    assert (r["idtp"], r["idfp"], r["idfn"]) == (100, 2, 2) and abs(r["idf1"] - 200 / 204) < 1e-9


def test_one_class_has_no_ranking(spark):
    from fieldtrace.operators import metrics

    d = spark.createDataFrame([("a", 0.4, True), ("b", 0.4, False), ("c", 0.2, True), ("c", 0.1, False)], "g string, p double, y boolean")
    got = {r["g"]: r for r in metrics.probability_metrics(d, ["g"], "p", F.col("y")).collect()}
    assert got["a"]["auc"] is None and got["b"]["average_precision"] is None and got["b"]["skill"] is None and got["c"]["auc"] == 1.0


def test_pass_options_of_a_crowded_frame(spark):
    """All options against all opponents by numpy; a frame of thousands takes seconds (before: an expression for each pair)."""
    import time

    from pyspark.sql import functions as F

    from fieldtrace.plans import pitch

    def frame(n):
        rng = np.random.default_rng(n)
        people = [(1, 1, 5, 3.0, int(i % 2), f"p{i}", float(rng.integers(0, 105)), float(rng.integers(0, 68))) for i in range(n)]
        return people, spark.createDataFrame([*people, (1, 1, 5, 3.0, None, "ball", 50.0, 30.0)], "game int, period int, frame int, time_s double, team int, player string, x_m double, y_m double")

    def options(tracking):
        event = spark.createDataFrame([(1, "e", 1, 3.0, 1, "p1", "p3")], "game int, event_id string, period int, time_s double, team int, passer string, receiver string")
        return pitch.pass_options(event, tracking, spark.createDataFrame([(1, 1, 1, -1)], "game int, period int, team int, direction int"))

    people, tracking = frame(60)
    got = {r["option"]: r for r in options(tracking).collect()}
    b, opp = np.array([55.0, 30.0]), np.array([(105.0 - p[6], p[7]) for p in people if p[4] == 0])
    want = {}
    for p in people:
        r = np.array([105.0 - p[6], p[7]])
        if p[4] == 1 and p[5] != "p1" and np.linalg.norm(r - b) >= 1:
            s = np.clip((opp - b) @ (r - b) / ((r - b) @ (r - b)), 0, 1)
            want[p[5]] = (np.linalg.norm(r - b), np.linalg.norm(opp - (b + s[:, None] * (r - b)), axis=1).min(), np.linalg.norm(opp - r, axis=1).min(), np.linalg.norm(opp - b, axis=1).min())
    assert set(got) == set(want) and [o for o, r in got.items() if r["chosen"]] == ["p3"]
    for o, w in want.items():
        assert np.allclose([got[o][c] for c in ("length", "lane_clearance", "receiver_pressure", "passer_pressure")], w, atol=1e-9)
    many, t0 = options(frame(6000)[1]), time.time()
    assert many.agg(F.sum("lane_clearance")).first()[0] is not None
    assert time.time() - t0 < 20


def test_team_centres_travel_to_the_rows(spark):
    """Vectors are not shuffled in each round: few jobs' centres are broadcast, and a file of one split is dealt to all tasks."""
    from fieldtrace.ml.models import team_clusters
    pts = spark.createDataFrame([(j, i, [float(i % 3 * 10), float(i)]) for j in range(2) for i in range(30)], "job int, id int, v array<double>").coalesce(1)
    plan = team_clusters(pts, ["job"], "id", "v", rounds=2)._jdf.queryExecution().sparkPlan().toString().splitlines()
    assert not any("SortMergeJoin" in x and "Inner" in x for x in plan) and any("BroadcastHashJoin" in x and "Inner" in x for x in plan)


def test_forest_rows_are_dealt_to_all_tasks(spark, monkeypatch):
    from fieldtrace.ml import models
    seen, fit = [], models.Pipeline.fit
    monkeypatch.setattr(models.Pipeline, "fit", lambda self, d: seen.append(d.rdd.getNumPartitions()) or fit(self, d))
    d = spark.createDataFrame([(i, float(i % 7), int(i % 7 > 3)) for i in range(80)], "id int, x double, y int").coalesce(1)
    m = models.forest(d, ["x"], "y", trees=3, depth=2)
    assert seen == [int(spark.conf.get("spark.sql.shuffle.partitions"))]
    assert {(r["y"], r["_pred"]) for r in m.transform(d).collect()} == {(0, 0.0), (1, 1.0)}
