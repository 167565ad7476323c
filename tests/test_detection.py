"""AGG-19/20/21 against plain Python: matching, ignore regions, precision over ten overlaps, assignment by component."""

import itertools
import math
import random
import statistics

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from fieldtrace.operators import detection_eval as de
from fieldtrace.operators import matching, reports

COLS = "x1 double, y1 double, x2 double, y2 double"


def iou(a, b, own=False):
    ix, iy = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if ix <= 0 or iy <= 0:
        return 0.0
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    return ix * iy / (area(a) if own else area(a) + area(b) - ix * iy)


@pytest.fixture(scope="module")
def world():
    rng = random.Random(12)
    near = lambda b, s: tuple(v + rng.uniform(-s, s) for v in b)
    truth, pred, crowds = [], [], []
    for f in range(25):
        for label in "ab":
            for _ in range(rng.randrange(6)):
                x, y, w = rng.uniform(0, 200), rng.uniform(0, 200), rng.choice([20, 60, 120])
                b = (x, y, x + w, y + w)
                truth.append((f"s{f % 2}", f, label, len(truth), *b))
                for _ in range(rng.randrange(3)):
                    pred.append((f"s{f % 2}", f, label, len(pred), rng.randrange(20) / 20, *near(b, w / 10)))
            for _ in range(rng.randrange(3)):
                x, y = rng.uniform(0, 200), rng.uniform(0, 200)
                pred.append((f"s{f % 2}", f, label, len(pred), rng.randrange(20) / 20, x, y, x + 25, y + 25))
        crowds.append((f"s{f % 2}", f, *(lambda x, y: (x, y, x + 60, y + 60))(rng.uniform(0, 200), rng.uniform(0, 200))))
    return truth, pred, crowds


def frames_of(spark, world):
    truth, pred, crowds = world
    t = spark.createDataFrame(truth, f"seq string, frame int, label string, truth_id int, {COLS}")
    p = spark.createDataFrame(pred, f"seq string, frame int, label string, pred_id int, score double, {COLS}")
    c = spark.createDataFrame(crowds, f"seq string, frame int, {COLS}")
    return t, p, c


def brute_ap(world, label, limit):
    truth, pred, crowds = world
    used, rows = set(), []
    for p in sorted((p for p in pred if p[2] == label), key=lambda p: (-p[4], p[0], p[1], p[3])):
        best = max(((iou(p[5:], t[4:]), t[3]) for t in truth if t[1:3] == p[1:3] and t[3] not in used), default=(0, None))
        if best[0] >= limit:
            used.add(best[1])
            rows.append(1)
        elif not any(c[1] == p[1] and iou(p[5:], c[2:], own=True) >= limit for c in crowds):
            rows.append(0)
    total, tp, points = sum(t[2] == label for t in truth), 0, []
    for n, hit in enumerate(rows, 1):
        tp += hit
        points.append((tp, tp / n))
    return sum(max((p for k, p in points if 100 * k >= r * total), default=0.0) for r in range(101)) / 101


def test_precision_like_plain_python(spark, world):
    t, p, c = frames_of(spark, world)
    table = de.precision_table(p, t, c, ["seq", "frame"], "label").cache()
    got = {(r["label"], round(r["threshold"], 2)): r["ap"] for r in table.collect()}
    assert len(got) == 20 and 0.1 < got["a", 0.5] < 1
    for (label, limit), ap in got.items():
        assert abs(ap - brute_ap(world, label, limit)) < 1e-12
    hot = {(r["label"], round(r["threshold"], 2)): r["ap"] for r in de.precision_table(p, t, c, ["seq", "frame"], "label", hot_rows=9).collect()}
    assert hot == got
    mean = {r["label"]: r for r in de.mean_precision(table, "label").collect()}
    assert abs(mean["a"]["map"] - sum(got["a", x / 100] for x in range(50, 100, 5)) / 10) < 1e-8 and abs(mean["all"]["ap50"] - (got["a", 0.5] + got["b", 0.5]) / 2) < 1e-8
    few = de.precision_table(p, t, c, ["seq", "frame"], "label", max_dets=1)
    assert few.filter("threshold = 0.5 AND label = 'a'").first()["ap"] < got["a", 0.5]
    none = de.precision_table(p.limit(0), t, c.limit(0), ["seq", "frame"], "label").collect()
    assert len(none) == 20 and all(r["ap"] == 0 for r in none)


@pytest.mark.parametrize("centre", [None, 30.0])
def test_report_like_plain_python(spark, world, centre):
    truth, pred, crowds = world
    t, p, c = frames_of(spark, world)
    poly = [(10.0, 10.0), (150.0, 20.0), (60.0, 190.0)]
    regions = c.select("seq", "frame", F.array(F.struct("x1", "y1", "x2", "y2")).alias("boxes"),
                       F.when(F.col("frame") % 3 == 0, F.array(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in poly]))).otherwise(F.array().cast("array<array<struct<x:double,y:double>>>")).alias("polygons"))
    manifest = spark.createDataFrame([(f"s{f % 2}", f) for f in range(27)], "seq string, frame int")
    got = {(r["label"], r["by"], r["size"]): r for r in de.detection_report(p, t, regions, manifest, ["seq", "frame"], "label", "seq", 0.2, 0.4, centre).collect()}
    mid = lambda b: ((b[0] + b[2]) / 2, (b[1] + b[3]) / 2)

    def inside(q, polygon):
        hit = False
        for (ax, ay), (bx, by) in zip(polygon, polygon[1:] + polygon[:1]):
            if (ay > q[1]) != (by > q[1]) and q[0] < (bx - ax) * (q[1] - ay) / (by - ay) + ax:
                hit = not hit
        return hit

    used, errors, fp, ignored, total = {}, [], 0, 0, 0
    for q in sorted((q for q in pred if q[4] >= 0.2), key=lambda q: (-q[4], q[3])):
        total += 1
        value = lambda x: -iou(q[5:], x[4:]) if centre is None else math.dist(mid(q[5:]), mid(x[4:]))  # noqa: B023, E731
        best = min(((value(x), x[3]) for x in truth if x[1:3] == q[1:3] and x[3] not in used), default=(math.inf, None))
        if best[0] <= (-0.4 if centre is None else centre):
            used[best[1]] = q
            errors.append(best[0])
        elif any(c_[1] == q[1] and iou(q[5:], c_[2:]) >= 0.4 for c_ in crowds) or (q[1] % 3 == 0 and inside(mid(q[5:]), poly)):
            ignored += 1
        else:
            fp += 1
    r = got["all", "all", "all"]
    assert (r["frames"], r["gt"], r["predictions"], r["tp"], r["fp"], r["fn"], r["ignored"]) == (27, len(truth), total, len(used), fp, len(truth) - len(used), ignored) and ignored
    area = lambda b: (b[2] - b[0]) * (b[3] - b[1])
    size = lambda b: "small" if area(b) < 1024 else "medium" if area(b) < 9216 else "large"
    for s in ("small", "medium", "large"):
        assert got["all", "all", s]["tp"] == sum(size(truth[i][4:]) == s for i in used) and got["a", "all", s]["gt"] == sum(size(x[4:]) == s and x[2] == "a" for x in truth)
    if centre:
        ordered = sorted(errors)
        assert abs(r["error_mean"] - statistics.mean(errors)) < 1e-8 and abs(r["error_median"] - statistics.median(errors)) < 1e-9
        assert abs(r["error_p95"] - ordered[math.ceil(len(ordered) * 0.95) - 1]) < 1e-9


def test_assignment_by_component(spark):
    rng = random.Random(4)
    rows = []
    for g in range(6):
        for block in range(4):  # a few tracks meet one another, never those of another block
            for left, right in itertools.product(range(3), range(3)):
                if rng.random() < 0.7:
                    rows.append((g, block * 10 + left, f"t{block}{right}", rng.randrange(1, 30)))
    d = spark.createDataFrame(rows, "g int, gt int, tr string, hits int")
    got = {}
    for r in matching.sparse_match(d, ["g"], "gt", "tr", "hits").collect():
        got.setdefault(r["g"], []).append((r["gt"], r["tr"]))
    score = {(g, a, b): h for g, a, b, h in rows}
    for g in range(6):
        assert len({a for a, _ in got[g]}) == len({b for _, b in got[g]}) == len(got[g])
        want = 0
        for block in range(4):
            ids = [(block * 10 + i) for i in range(3)]
            want += max(sum(score.get((g, a, f"t{block}{b}"), 0) for a, b in zip(ids, order, strict=True)) for order in itertools.permutations(range(3)))
        assert sum(score[g, a, b] for a, b in got[g]) == want


def test_only_reviewed_frames_are_scored(spark):
    t = spark.createDataFrame([("s", f, "p", g, 10.0 * g, 0.0, 10.0 * g + 8, 8.0) for f in range(4) for g in range(2)], f"seq string, frame int, label string, gt int, {COLS}")
    p = t.withColumnRenamed("gt", "tr").unionByName(spark.createDataFrame([("s", 9, "p", 7, 0.0, 0.0, 5.0, 5.0)], f"seq string, frame int, label string, tr int, {COLS}"))
    cover = spark.createDataFrame([("s", f, "p", True) for f in range(4)] + [("s", 0, "ball", True)], "seq string, frame int, label string, exhaustive boolean")
    score = lambda t, p, cover: {r["label"]: r for r in reports.reviewed_tracking(t, p, cover, ["seq"], "frame", "label", [0.5, 0.75]).collect()}
    got = score(t, p, cover)
    assert got["p"]["frames"] == 4 and got["p"]["pred_boxes"] == 8 and got["p"]["hota"] == 1.0 and got["p"]["hota_by_iou"] == [1.0, 1.0] and got["p"]["idtp"] == 8
    assert got["ball"]["frames"] == 1 and got["ball"]["truth_boxes"] == 0 and got["ball"]["idtp"] == 0
    for bad in ((t, p, cover.filter("frame < 2")), (t, p, cover.withColumn("exhaustive", F.col("frame") > 0)), (t.withColumn("x2", F.col("x1")), p, cover)):
        with pytest.raises(PySparkException):
            score(*bad)
    with pytest.raises(ValueError):
        score(t.unionByName(t), p, cover)


def test_chains_count_their_flips(spark):
    rows, n = [], 0
    for f in (1, 2, 4, 5):  # frame 3 has no boxes, so 2 and 4 are neighbours
        for lane, track in ((0.0, "a" if f < 4 else "b"), (100.0, "c")):
            rows.append(("m", f, n, track, lane + f, 0.0, lane + f + 20, 20.0))
            n += 1
    rows += [("m", 5, n, "d", 500.0, 0.0, 520.0, 20.0), ("m", 5, n + 1, "e", 6.0, 8.0, 26.0, 28.0)]  # alone, and a poorer match of the first lane
    r = de.chain_churn(spark.createDataFrame(rows, f"match string, frame int, id int, track string, {COLS}"), ["match"], "frame", "id", "track", 0.3, 3).first()
    assert (r["chains"], r["long_chains"], r["flipped"], r["flips"], r["most_flips"]) == (4, 2, 1, 1, 1) and r["flip_rate"] == 0.5 and r["flips_per_chain"] == 0.5
