"""Court, pitch and box geometry as column expressions (plain arithmetic, whole-stage codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the court and pitch models (feet for the court, metres for the pitch).
COURT_LENGTH, COURT_WIDTH = 94.0, 50.0
RIM_OFFSET = 5.25
RIM_Y = 25.0
THREE_RADIUS = 22.146
CORNER_LINE = 3.344
RESTRICTED_RADIUS = 4.0
LANE_HALF_WIDTH = 6.0
FT_LINE = 19.0
CORNER3_MAX_X = 14.0
PITCH_LENGTH, PITCH_WIDTH = 105.0, 68.0


def dist(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = x1 - x2, y1 - y2
    return F.sqrt(dx * dx + dy * dy)


def project(h: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """FN-01: homography (row-major array of nine) with perspective divide."""
    w = h[6] * x + h[7] * y + h[8]
    return (h[0] * x + h[1] * y + h[2]) / w, (h[3] * x + h[4] * y + h[5]) / w


def ground_point(x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    """FN-02: bottom centre of a box."""
    return (x1 + x2) / 2.0, y2


def on_court(x: Column, y: Column, margin: float = 3.0) -> Column:
    """FN-03: closed bounds test with a margin."""
    return x.between(-margin, COURT_LENGTH + margin) & y.between(-margin, COURT_WIDTH + margin)


def rim_distance(x: Column, y: Column, end: Column) -> Column:
    """FN-04: distance to the basket of the attacked end."""
    rx = F.when(end == "left", RIM_OFFSET).otherwise(COURT_LENGTH - RIM_OFFSET)
    return dist(x, y, rx, F.lit(RIM_Y))


def is_three(x: Column, y: Column, end: Column) -> Column:
    """FN-04: outside the arc, or in a corner strip."""
    return (rim_distance(x, y, end) > THREE_RADIUS) | (F.abs(y - RIM_Y) > RIM_Y - CORNER_LINE)


def baseline_x(x: Column, end: Column) -> Column:
    """FN-09: distance from the attacked baseline."""
    return F.when(end == "left", x).otherwise(COURT_LENGTH - x)


def zone(x: Column, y: Column, end: Column, margin: float = 3.0) -> Column:
    """FN-05: shot zone; the order of the tests matters."""
    bx = baseline_x(x, end)
    return (
        F.when(~on_court(x, y, margin), "out_of_bounds")
        .when(bx > COURT_LENGTH / 2, "backcourt")
        .when(rim_distance(x, y, end) <= RESTRICTED_RADIUS, "restricted_area")
        .when((F.abs(y - RIM_Y) <= LANE_HALF_WIDTH) & (bx <= FT_LINE), "paint")
        .when(is_three(x, y, end) & (bx <= CORNER3_MAX_X), "corner3")
        .when(is_three(x, y, end), "above_break3")
        .otherwise("midrange")
    )


def iou(a: tuple, b: tuple, floor: float = 0.0) -> Column:
    """FN-06: intersection over union of two (x1, y1, x2, y2) boxes; 0 without overlap or union."""
    ix = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    iy = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    inter = ix * iy
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    if floor:
        union = F.greatest(union, F.lit(floor))
    return F.when((ix <= 0) | (iy <= 0) | (union <= 0), 0.0).otherwise(inter / union)


def own_overlap(a: tuple, b: tuple) -> Column:
    """JOIN-35: intersection over the first box's own area."""
    inter = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0)) * F.greatest(
        F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    area = (a[2] - a[0]) * (a[3] - a[1])
    return F.when(area > 0, inter / area).otherwise(0.0)


def box_to_point(box: tuple, x: Column, y: Column) -> Column:
    """FN-07: distance from a point to a box, 0 inside."""
    dx = F.greatest(box[0] - x, x - box[2], F.lit(0.0))
    dy = F.greatest(box[1] - y, y - box[3], F.lit(0.0))
    return F.sqrt(dx * dx + dy * dy)


def center_distance(a: tuple, b: tuple) -> Column:
    """FN-07: distance between box centres."""
    return dist((a[0] + a[2]) / 2.0, (a[1] + a[3]) / 2.0, (b[0] + b[2]) / 2.0, (b[1] + b[3]) / 2.0)


def size_bucket(box: tuple) -> Column:
    """FN-07: small below 32 squared, medium below 96 squared."""
    area = (box[2] - box[0]) * (box[3] - box[1])
    return F.when(area < 32.0**2, "small").when(area < 96.0**2, "medium").otherwise("large")


def in_polygon(x: Column, y: Column, polygon: Column) -> Column:
    """FN-08: ray casting over an array of struct(x, y) vertices."""
    n = F.size(polygon)

    def crossing(i):
        cur = F.get(polygon, i)
        prv = F.get(polygon, F.when(i == 0, n - 1).otherwise(i - 1))
        hit = ((prv["y"] > y) != (cur["y"] > y)) & (
            x < (cur["x"] - prv["x"]) * (y - prv["y"]) / (cur["y"] - prv["y"]) + prv["x"])
        return F.when(hit, 1).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + crossing(i)) % 2 == 1


def ignored(box: tuple, boxes: Column, polygons: Column, threshold: float) -> Column:
    """FN-08: overlaps an ignored box enough, or its centre lies in an ignore polygon."""
    cx, cy = (box[0] + box[2]) / 2.0, (box[1] + box[3]) / 2.0
    by_box = F.exists(boxes, lambda b: iou(box, (b["x1"], b["y1"], b["x2"], b["y2"])) >= threshold)
    return by_box | F.exists(polygons, lambda p: in_polygon(cx, cy, p))


def orient(x: Column, direction: Column, length: float = PITCH_LENGTH) -> Column:
    """FN-09: flip the length axis for teams attacking the other way."""
    return F.when(direction == -1, length - x).otherwise(x)


def lane_clearance(bx: Column, by: Column, rx: Column, ry: Column, ox: Column, oy: Column) -> Column:
    """Distance of a point from the segment (b, r)."""
    dx, dy = rx - bx, ry - by
    s = ((ox - bx) * dx + (oy - by) * dy) / (dx * dx + dy * dy)
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), s))
    return dist(ox, oy, bx + s * dx, by + s * dy)


def pass_geometry(bx: Column, by: Column, rx: Column, ry: Column, opponents: Column) -> Column:
    """FN-19: struct of pass measures, null when shorter than 1 or without opponents.

    ``opponents`` is an array of struct(x, y).
    """
    length = dist(rx, ry, bx, by)

    def nearest(fn):
        return F.array_min(F.transform(opponents, fn))

    geometry = F.struct(
        length.alias("length"), (rx - bx).alias("forward"), F.abs(ry - by).alias("lateral"),
        nearest(lambda o: lane_clearance(bx, by, rx, ry, o["x"], o["y"])).alias("lane_clearance"),
        nearest(lambda o: dist(o["x"], o["y"], rx, ry)).alias("receiver_pressure"),
        nearest(lambda o: dist(o["x"], o["y"], bx, by)).alias("passer_pressure"), rx.alias("receiver_x"))
    return F.when((length >= 1) & (F.size(opponents) > 0), geometry)


def phase(progress: Column) -> Column:
    """FN-20: pitch thirds."""
    return F.when(progress < 35, "build_up").when(progress < 70, "middle_third").otherwise("final_third")


def pressured(nearest_opponent: Column) -> Column:
    """FN-20: an opponent within 3 m."""
    return nearest_opponent <= 3.0


def plausible_end(cx: Column, cy: Column, grounds: dict[str, tuple[Column, Column]], width: Column, height: Column,
                  max_dx: float, above: tuple[float, float]) -> Column:
    """FN-29: the known ground point horizontally nearest to the box centre among those it hangs
    plausibly above; null when none qualifies (first listed wins a tie)."""
    best = F.lit(None).cast("struct<dx:double,i:int,end:string>")
    for i, (end, (gx, gy)) in enumerate(grounds.items()):
        dx, up = F.abs(cx - gx), gy - cy
        ok = (dx <= max_dx * width) & up.between(above[0] * height, above[1] * height)
        cand = F.when(ok, F.struct(dx.cast("double").alias("dx"), F.lit(i).alias("i"), F.lit(end).alias("end")))
        best = cand if i == 0 else F.least(best, cand)  # least skips nulls
    return best["end"]


def clip_box(box: tuple, width: float, height: float) -> Column:
    """FN-21: box clipped to the image, null when nothing is left."""
    lo = lambda v, m: F.greatest(F.lit(0.0), F.least(v, F.lit(float(m))))
    x1, y1, x2, y2 = lo(box[0], width), lo(box[1], height), lo(box[2], width), lo(box[3], height)
    s = F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))
    return F.when((x2 > x1) & (y2 > y1), s)
