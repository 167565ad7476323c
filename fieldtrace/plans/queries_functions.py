"""Scalar and array functions over columns derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtrace.functions import decide, geometry as G, text as X
from fieldtrace.plans.registry import EV, Tables, query

# x in [-4, 98), y in [-4, 56): spread a little past the court
XY = f"""{EV}, p AS (SELECT event_id, user_id, k * 1.02::DOUBLE - 4.0::DOUBLE AS x, (cents % 6000) / 100.0::DOUBLE - 4.0::DOUBLE AS y,
  CASE WHEN user_id % 2 = 0 THEN 'left' ELSE 'right' END AS "end", cents, k, us FROM ev)"""
RIM = """sqrt((x - CASE WHEN "end" = 'left' THEN 5.25::DOUBLE ELSE 88.75::DOUBLE END) * (x - CASE WHEN "end" = 'left' THEN 5.25::DOUBLE ELSE 88.75::DOUBLE END)
  + (y - 25.0::DOUBLE) * (y - 25.0::DOUBLE))"""
BX = """(CASE WHEN "end" = 'left' THEN x ELSE 94.0::DOUBLE - x END)"""
THREE = f"({RIM} > 22.146::DOUBLE OR abs(y - 25.0::DOUBLE) > 25.0::DOUBLE - 3.344::DOUBLE)"


def xy(t: Tables):
    return t.ev.select(
        "event_id", "user_id", (F.col("k") * 1.02 - 4.0).alias("x"), ((F.col("cents") % 6000) / 100.0 - 4.0).alias("y"),
        F.when(F.col("user_id") % 2 == 0, "left").otherwise("right").alias("end"), "cents", "k", "us")


x, y, end = F.col, F.col, F.col


@query("fn01_project", f"""WITH {XY}
SELECT event_id, (1.5::DOUBLE * x + 0.25::DOUBLE * y + 3.0) / (0.001::DOUBLE * x + 0.002::DOUBLE * y + 1.0) AS px,
  (0.125::DOUBLE * x + 2.0::DOUBLE * y + 7.0) / (0.001::DOUBLE * x + 0.002::DOUBLE * y + 1.0) AS py FROM p""")
def _(t: Tables):
    h = F.array(*[F.lit(v) for v in (1.5, 0.25, 3.0, 0.125, 2.0, 7.0, 0.001, 0.002, 1.0)])
    px, py = G.project(h, F.col("x"), F.col("y"))
    return xy(t).select("event_id", px.alias("px"), py.alias("py"))


@query("fn05_zones", f"""WITH {XY}, z AS (SELECT event_id, CASE
  WHEN NOT (x BETWEEN -3 AND 97 AND y BETWEEN -3 AND 53) THEN 'out_of_bounds' WHEN {BX} > 47 THEN 'backcourt'
  WHEN {RIM} <= 4 THEN 'restricted_area' WHEN abs(y - 25.0::DOUBLE) <= 6 AND {BX} <= 19 THEN 'paint'
  WHEN {THREE} AND {BX} <= 14 THEN 'corner3' WHEN {THREE} THEN 'above_break3' ELSE 'midrange' END AS zone FROM p)
SELECT event_id, zone FROM z""")
def _(t: Tables):
    return xy(t).select("event_id", G.zone(F.col("x"), F.col("y"), F.col("end")).alias("zone"))


@query("fn03_fn04_court_tests", f"""WITH {XY}
SELECT event_id, x BETWEEN -3 AND 97 AND y BETWEEN -3 AND 53 AS on_court, {RIM} AS rim, {THREE} AS three, {BX} AS bx FROM p""")
def _(t: Tables):
    a = (F.col("x"), F.col("y"), F.col("end"))
    return xy(t).select("event_id", G.on_court(*a[:2]).alias("on_court"), G.rim_distance(*a).alias("rim"),
                        G.is_three(*a).alias("three"), G.baseline_x(a[0], a[2]).alias("bx"))


BOX = """b AS (SELECT l_orderkey, l_linenumber, l_quantity AS x1, CAST(l_linenumber AS DOUBLE) AS y1,
  l_quantity + l_linenumber * 12.0::DOUBLE AS x2, l_linenumber + l_quantity * 3.0::DOUBLE AS y2 FROM lineitem)"""


def boxes(t: Tables):
    q, n = F.col("l_quantity"), F.col("l_linenumber").cast("double")
    return t.lineitem.select("l_orderkey", "l_linenumber", q.alias("x1"), n.alias("y1"),
                             (q + n * 12.0).alias("x2"), (n + q * 3.0).alias("y2"))


def box(prefix: str = ""):
    return tuple(F.col(prefix + c) for c in ("x1", "y1", "x2", "y2"))


@query("fn02_fn07_box_measures", f"""WITH {BOX}
SELECT l_orderkey, l_linenumber, (x1 + x2) / 2.0::DOUBLE AS gx, y2 AS gy,
  CASE WHEN (x2-x1)*(y2-y1) < 1024 THEN 'small' WHEN (x2-x1)*(y2-y1) < 9216 THEN 'medium' ELSE 'large' END AS size,
  sqrt(greatest(x1 - 40.0::DOUBLE, 40.0::DOUBLE - x2, 0.0) * greatest(x1 - 40.0::DOUBLE, 40.0::DOUBLE - x2, 0.0)
     + greatest(y1 - 50.0::DOUBLE, 50.0::DOUBLE - y2, 0.0) * greatest(y1 - 50.0::DOUBLE, 50.0::DOUBLE - y2, 0.0)) AS to_point FROM b""")
def _(t: Tables):
    gx, gy = G.ground_point(*box())
    return boxes(t).select("l_orderkey", "l_linenumber", gx.alias("gx"), gy.alias("gy"), G.size_bucket(box()).alias("size"),
                           G.box_to_point(box(), F.lit(40.0), F.lit(50.0)).alias("to_point"))


@query("fn06_iou_with_frame_box", f"""WITH {BOX}, i AS (SELECT *, least(x2, 60.0::DOUBLE) - greatest(x1, 20.0::DOUBLE) AS ix,
  least(y2, 90.0::DOUBLE) - greatest(y1, 10.0::DOUBLE) AS iy FROM b)
SELECT l_orderkey, l_linenumber, CASE WHEN ix <= 0 OR iy <= 0 THEN 0.0::DOUBLE
  ELSE (ix * iy) / ((x2 - x1) * (y2 - y1) + 40.0::DOUBLE * 80.0::DOUBLE - ix * iy) END AS iou FROM i""")
def _(t: Tables):
    frame = tuple(F.lit(v) for v in (20.0, 10.0, 60.0, 90.0))
    return boxes(t).select("l_orderkey", "l_linenumber", G.iou(box(), frame).alias("iou"))


POLY = [(10.0, 5.0), (60.0, 10.0), (80.0, 45.0), (30.0, 30.0), (5.0, 48.0)]


def _ray(px: str, py: str) -> str:
    parts = []
    for i, (x2, y2) in enumerate(POLY):
        x1, y1 = POLY[i - 1]
        parts.append(f"CASE WHEN ({y1}::DOUBLE > {py}) <> ({y2}::DOUBLE > {py}) AND {px} < ({x2}::DOUBLE - {x1}::DOUBLE) * ({py} - {y1}::DOUBLE) "
                     f"/ ({y2}::DOUBLE - {y1}::DOUBLE) + {x1}::DOUBLE THEN 1 ELSE 0 END")
    return f"(({' + '.join(parts)}) % 2 = 1)"


@query("fn08_in_polygon", f"WITH {XY} SELECT event_id, {_ray('x', 'y')} AS inside FROM p")
def _(t: Tables):
    poly = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in POLY])
    return xy(t).select("event_id", G.in_polygon(F.col("x"), F.col("y"), poly).alias("inside"))


@query("fn09_orient", f"WITH {XY} SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 105.0::DOUBLE - x ELSE x END AS ox FROM p")
def _(t: Tables):
    d = F.when(F.col("user_id") % 3 == 0, -1).otherwise(1)
    return xy(t).select("event_id", G.orient(F.col("x"), d).alias("ox"))


@query("fn10_numbers", """SELECT doc_id, CASE WHEN n <= 99 THEN CAST(n AS VARCHAR) END AS number
FROM (SELECT doc_id, TRY_CAST(nullif(regexp_extract(text, '[0-9]+'), '') AS INTEGER) AS n FROM documents)""")
def _(t: Tables):
    return t.documents.select("doc_id", X.first_digits(F.col("text")).alias("number"))


@query("fn11_truncation", f"""WITH {EV}, r AS (SELECT user_id, list(DISTINCT CAST(k AS VARCHAR)) AS roster FROM ev WHERE event_type = 'signup' GROUP BY user_id)
SELECT event_id, length(CAST(k AS VARCHAR)) = 1 AND len(list_filter(roster, lambda n: length(n) = 2 AND contains(n, CAST(k AS VARCHAR)))) > 0 AS ambiguous,
  CASE WHEN event_type <> 'view' THEN true ELSE list_contains(roster, CAST(k AS VARCHAR)) AND NOT (length(CAST(k AS VARCHAR)) = 1
    AND len(list_filter(roster, lambda n: length(n) = 2 AND contains(n, CAST(k AS VARCHAR)))) > 0) END AS allowed
FROM ev JOIN r USING (user_id)""")
def _(t: Tables):
    """Reads against the user's roster of at most 101 numbers; views are the bound cluster."""
    r = t.ev.filter("event_type = 'signup'").groupBy("user_id").agg(F.collect_set(F.col("k").cast("string")).alias("roster"))
    d = t.ev.join(r, "user_id")
    c = F.col("k").cast("string")
    return d.select("event_id", X.truncation_ambiguous(c, F.col("roster")).alias("ambiguous"),
                    X.attribution_allowed(c, (F.col("event_type") == "view").cast("int"), F.lit(1), F.col("roster")).alias("allowed"))


@query("fn12_clock", f"""WITH {EV}, c AS (SELECT event_id, CASE WHEN event_type = 'click' THEN (k % 20) || ':' || lpad(CAST(cents % 75 AS VARCHAR), 2, '0')
  WHEN event_type = 'view' THEN (k % 70) || '.' || (cents % 10) ELSE event_type END AS txt FROM ev)
SELECT event_id, txt, CASE WHEN contains(txt, ':') THEN CASE WHEN CAST(split_part(txt, ':', 2) AS INTEGER) < 60
    THEN (CAST(split_part(txt, ':', 1) AS INTEGER) * 60 + CAST(split_part(txt, ':', 2) AS INTEGER))::DOUBLE END
  WHEN contains(txt, '.') AND TRY_CAST(txt AS DOUBLE) < 60 THEN TRY_CAST(txt AS DOUBLE) END AS seconds FROM c""")
def _(t: Tables):
    k, c, e = F.col("k"), F.col("cents"), F.col("event_type")
    txt = F.when(e == "click", F.concat_ws(":", (k % 20).cast("string"), F.lpad((c % 75).cast("string"), 2, "0"))).when(
        e == "view", F.concat_ws(".", (k % 70).cast("string"), (c % 10).cast("string"))).otherwise(e)
    return t.ev.select("event_id", txt.alias("txt")).withColumn("seconds", X.parse_clock(F.col("txt")))


@query("fn13_title_windows", """WITH ti AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'Duke vs. UNC Full Game Replay | ' || month(o_orderdate) || '-' || day(o_orderdate) || '-' || year(o_orderdate) || '.mp4'
  WHEN o_orderkey % 5 = 1 THEN 'Duke vs UNC Full Match | ' || year(o_orderdate) || ' ACC Tournament' || '.mp4'
  WHEN o_orderkey % 5 = 2 THEN 'Duke vs. UNC Game Replay 2025-26 ACC.mp4'
  WHEN o_orderkey % 5 = 3 THEN 'Highlights | 2024 ACC.mp4' ELSE 'Duke at UNC.mp4' END AS title, o_orderdate FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 3 THEN 'Duke' END AS side_a, CASE WHEN o_orderkey % 5 < 3 THEN 'North Carolina' END AS side_b,
  CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate - INTERVAL 1 DAY, '%Y%m%d') WHEN 1 THEN CASE WHEN year(o_orderdate) >= 2000 THEN year(o_orderdate) || '0301' END WHEN 2 THEN '20251101' WHEN 3 THEN '20240101' END AS lo,
  CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate + INTERVAL 1 DAY, '%Y%m%d') WHEN 1 THEN CASE WHEN year(o_orderdate) >= 2000 THEN year(o_orderdate) || '0415' END WHEN 2 THEN '20260430' WHEN 3 THEN '20240430' END AS hi FROM ti""")
def _(t: Tables):
    d = F.col("o_orderdate")
    m = F.col("o_orderkey") % 5
    title = (
        F.when(m == 0, F.concat(F.lit("Duke vs. UNC Full Game Replay | "), F.concat_ws("-", F.month(d), F.dayofmonth(d), F.year(d)), F.lit(".mp4")))
        .when(m == 1, F.concat(F.lit("Duke vs UNC Full Match | "), F.year(d), F.lit(" ACC Tournament.mp4")))
        .when(m == 2, F.lit("Duke vs. UNC Game Replay 2025-26 ACC.mp4"))
        .when(m == 3, F.lit("Highlights | 2024 ACC.mp4")).otherwise("Duke at UNC.mp4"))
    alias = F.create_map(F.lit("UNC"), F.lit("North Carolina"))
    s = t.orders.select("o_orderkey", title.alias("title"))
    pair, win = X.matchup(F.col("title"), alias), X.title_date_window(F.col("title"))
    return s.select("o_orderkey", pair["a"].alias("side_a"), pair["b"].alias("side_b"), win["lo"].alias("lo"), win["hi"].alias("hi"))


@query("fn14_lexicon_hits", """WITH lx AS (SELECT lower(split_part(p_name, ' ', 1)) AS w, p_brand AS e FROM part
  UNION SELECT unnest(['the', 'and', 'of']) AS w, 'Brand#1' AS e),
g AS (SELECT w, list_sort(list(DISTINCT e)) AS candidates FROM lx GROUP BY w),
tk AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z'']+')) AS w FROM documents)
SELECT doc_id, tk.w AS word, candidates, len(candidates) > 1 AS ambiguous FROM tk JOIN g ON tk.w = g.w""")
def _(t: Tables):
    lex = t.part.select(F.get(F.split("p_name", " "), F.lit(0)).alias("w"), F.col("p_brand").alias("e"))
    extra = lex.sparkSession.createDataFrame([(w, "Brand#1") for w in ("the", "and", "of")], "w string, e string")
    return X.lexicon_hits(t.documents, lex.unionByName(extra), ["doc_id"], "text", "w", "e")


@query("fn15_free_throws", """SELECT p_partkey, contains(replace(lower(p_type || CASE WHEN p_size % 7 = 0 THEN ' Free Throw' ELSE '' END), ' ', ''), 'freethrow') AS ft FROM part""")
def _(t: Tables):
    txt = F.concat("p_type", F.when(F.col("p_size") % 7 == 0, " Free Throw").otherwise(""))
    return t.part.select("p_partkey", X.is_free_throw(txt).alias("ft"))


@query("fn16_frame_time", f"""WITH {EV}, s AS (SELECT user_id, min(event_id) AS f0, max(event_id) AS f1, min(us) AS t0, max(us) AS t1 FROM ev WHERE event_type <> 'error' GROUP BY user_id)
SELECT event_id, user_id, CASE WHEN k % 10 = 0 THEN t0 ELSE t0 + CAST(trunc((t1 - t0) * least(greatest((event_id - f0)::DOUBLE / greatest(f1 - f0, 1), 0.0::DOUBLE), 1.0::DOUBLE)) AS BIGINT) END AS at_us FROM ev JOIN s USING (user_id)""")
def _(t: Tables):
    """Time of a frame number inside its track's span; a missing frame takes the span start."""
    from fieldtrace.operators.tracks import frame_time
    spans = t.ev.filter("event_type <> 'error'").groupBy("user_id").agg(
        F.min("event_id").alias("f0"), F.max("event_id").alias("f1"), F.min("us").alias("t0"), F.max("us").alias("t1"))
    rows = t.ev.select("event_id", "user_id", F.when(F.col("k") % 10 != 0, F.col("event_id")).alias("frame"))
    return frame_time(rows, spans, ["user_id"], "frame").select("event_id", "user_id", "at_us")


@query("fn17_json_payload", """SELECT event_id, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k,
  '{"kind":"' || event_type || '","k":' || regexp_extract(props, '[0-9]+') || '}' AS payload FROM events""")
def _(t: Tables):
    k = F.from_json("props", "struct<k: bigint>")["k"]
    return t.events.select("event_id", k.alias("k"), F.to_json(F.struct(F.col("event_type").alias("kind"), k.alias("k"))).alias("payload"))


@query("fn18_restrict_distribution", f"""WITH {EV}, n AS (SELECT user_id, count_if(event_type='click') AS a, count_if(event_type='view') AS b,
  count_if(event_type='purchase') AS c, count_if(event_type='error') AS e, count(*) AS n FROM ev WHERE event_type <> 'signup' GROUP BY user_id)
SELECT user_id, (a::DOUBLE / n) / (0.0 + a::DOUBLE / n + c::DOUBLE / n) * (1.0 - e::DOUBLE / n) AS p0, 0.0::DOUBLE AS p1,
  (c::DOUBLE / n) / (0.0 + a::DOUBLE / n + c::DOUBLE / n) * (1.0 - e::DOUBLE / n) AS p2, e::DOUBLE / n AS p3 FROM n WHERE a + c > 0""")
def _(t: Tables):
    """Share of clicks, views, purchases and errors ("unreadable") limited to clicks and purchases."""
    n = t.ev.filter("event_type <> 'signup'").groupBy("user_id").agg(
        *[F.count_if(F.col("event_type") == e).alias(e) for e in ("click", "view", "purchase", "error")], F.count(F.lit(1)).alias("n"))
    p = F.array(*[F.col(e).cast("double") / F.col("n") for e in ("click", "view", "purchase", "error")])
    r = n.filter("click + purchase > 0").select("user_id", decide.restrict_to_lineup(p, F.array(F.lit(0), F.lit(2))).alias("r"))
    return r.select("user_id", *[F.get("r", F.lit(i)).alias(f"p{i}") for i in range(4)])


@query("fn19_pass_geometry", f"""WITH {XY}, q AS (SELECT event_id, x, y, lead(x) OVER w AS rx, lead(y) OVER w AS ry, lead(x, 2) OVER w AS ax, lead(y, 2) OVER w AS ay,
  lead(x, 3) OVER w AS cx, lead(y, 3) OVER w AS cy FROM p WINDOW w AS (PARTITION BY user_id ORDER BY us)),
g AS (SELECT *, sqrt((rx-x)*(rx-x) + (ry-y)*(ry-y)) AS len,
  greatest(0.0, least(1.0, ((ax-x)*(rx-x) + (ay-y)*(ry-y)) / ((rx-x)*(rx-x) + (ry-y)*(ry-y)))) AS sa,
  greatest(0.0, least(1.0, ((cx-x)*(rx-x) + (cy-y)*(ry-y)) / ((rx-x)*(rx-x) + (ry-y)*(ry-y)))) AS sc FROM q WHERE cx IS NOT NULL)
SELECT event_id, len AS length, rx - x AS forward, abs(ry - y) AS lateral,
  least(sqrt((ax-(x+sa*(rx-x)))*(ax-(x+sa*(rx-x))) + (ay-(y+sa*(ry-y)))*(ay-(y+sa*(ry-y)))), sqrt((cx-(x+sc*(rx-x)))*(cx-(x+sc*(rx-x))) + (cy-(y+sc*(ry-y)))*(cy-(y+sc*(ry-y))))) AS lane_clearance,
  least(sqrt((ax-rx)*(ax-rx)+(ay-ry)*(ay-ry)), sqrt((cx-rx)*(cx-rx)+(cy-ry)*(cy-ry))) AS receiver_pressure,
  least(sqrt((ax-x)*(ax-x)+(ay-y)*(ay-y)), sqrt((cx-x)*(cx-x)+(cy-y)*(cy-y))) AS passer_pressure FROM g WHERE len >= 1""")
def _(t: Tables):
    """Next point receives, the two after it oppose."""
    from fieldtrace.operators.ordered import next_, scan
    d = xy(t)
    for i in range(3):
        d = scan(d, ["user_id"], ["us"], {f"n{i}": next_(F.struct("x", "y") if i == 0 else F.col(f"n{i - 1}"))})
    g = G.pass_geometry(F.col("x"), F.col("y"), F.col("n0.x"), F.col("n0.y"), F.array("n1", "n2"))
    d = d.filter("n2 is not null").select("event_id", g.alias("g")).filter("g is not null")
    return d.select("event_id", *[f"g.{c}" for c in ("length", "forward", "lateral", "lane_clearance", "receiver_pressure", "passer_pressure")])


@query("fn20_snapshot_labels", f"""WITH {XY} SELECT event_id, CASE WHEN x < 35 THEN 'build_up' WHEN x < 70 THEN 'middle_third' ELSE 'final_third' END AS phase, y <= 3.0 AS pressure, 11 - k % 7 AS rest FROM p""")
def _(t: Tables):
    return xy(t).select("event_id", G.phase(F.col("x")).alias("phase"), G.pressured(F.col("y")).alias("pressure"),
                        (F.lit(11) - F.col("k") % 7).alias("rest"))


@query("fn21_clip_boxes", f"""WITH {BOX}, c AS (SELECT l_orderkey, l_linenumber, greatest(0.0, least(x1 - 10.0::DOUBLE, 60.0::DOUBLE)) AS a, greatest(0.0, least(y1 - 5.0::DOUBLE, 80.0::DOUBLE)) AS b,
  greatest(0.0, least(x2 - 30.0::DOUBLE, 60.0::DOUBLE)) AS c, greatest(0.0, least(y2 - 5.0::DOUBLE, 80.0::DOUBLE)) AS d FROM b)
SELECT l_orderkey, l_linenumber, a AS x1, b AS y1, c AS x2, d AS y2 FROM c WHERE c > a AND d > b""")
def _(t: Tables):
    b = (F.col("x1") - 10.0, F.col("y1") - 5.0, F.col("x2") - 30.0, F.col("y2") - 5.0)
    d = boxes(t).select("l_orderkey", "l_linenumber", G.clip_box(b, 60, 80).alias("b"))
    return d.filter("b is not null").select("l_orderkey", "l_linenumber", "b.*")


@query("fn22_legacy_column", f"""WITH {EV} SELECT event_id, coalesce(CASE WHEN k % 3 = 0 THEN k % 2 END, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 END) AS team FROM ev""")
def _(t: Tables):
    new = F.when(F.col("k") % 3 == 0, F.col("k") % 2)
    old = F.when(F.col("event_type") == "click", "left").when(F.col("event_type") == "view", "right")
    return t.ev.select("event_id", decide.offense_cluster(new, old).alias("team"))


@query("fn23_logit", f"""WITH {EV} SELECT event_id, greatest(-30.0::DOUBLE, least(30.0::DOUBLE, -0.25::DOUBLE + 1.5::DOUBLE * ((CASE WHEN k > 90 THEN 50.0::DOUBLE ELSE k::DOUBLE END - 50.0::DOUBLE) / 29.0::DOUBLE)
  + -2.0::DOUBLE * ((cents::DOUBLE - 5000.0::DOUBLE) / 4000.0::DOUBLE) + 0.75::DOUBLE * ((CASE event_type WHEN 'click' THEN 1.0::DOUBLE WHEN 'view' THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END - 0.0::DOUBLE) / 1.0::DOUBLE))) AS z FROM ev""")
def _(t: Tables):
    flag = F.when(F.col("event_type") == "click", True).when(F.col("event_type") == "view", False)
    z = decide.logit({"k": F.when(F.col("k") <= 90, F.col("k")), "v": F.col("cents"), "m": decide.half_if_null(flag)},
                     {"k": 1.5, "v": -2.0, "m": 0.75}, -0.25, {"k": 50.0, "v": 5000.0}, {"k": 29.0, "v": 4000.0}, {"k": 50.0})
    return t.ev.select("event_id", z.alias("z"))


@query("fn24_thin_channel")
def _(t: Tables):
    """Deterministic thinning of the view channel (xxhash64 has no oracle twin)."""
    keep = (F.col("event_type") != "view") | decide.thin([F.col("event_id")], 7, 0.3)
    return t.ev.filter(keep).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("fn26_structural_flags", f"""WITH {EV}, g AS (SELECT user_id, count_if(event_type='purchase' AND k >= 50) AS made, list(DISTINCT k % 2 ORDER BY k % 2) FILTER (event_type='click') AS teams FROM ev GROUP BY user_id)
SELECT user_id, list_filter([CASE WHEN made > 0 AND teams IS NOT NULL AND NOT list_contains(teams, user_id % 2) THEN 'made_shot_without_offense_control' END,
  CASE WHEN made > 0 AND teams IS NULL THEN 'made_shot_without_any_ball_control' END], lambda s: s IS NOT NULL) AS flags FROM g""")
def _(t: Tables):
    g = t.ev.groupBy("user_id").agg(F.count_if((F.col("event_type") == "purchase") & (F.col("k") >= 50)).alias("made"),
                                    F.collect_set(F.when(F.col("event_type") == "click", F.col("k") % 2)).alias("teams"))
    return g.select("user_id", decide.structural_flags(F.col("made"), F.col("teams"), F.col("user_id") % 2).alias("flags"))


@query("fn27_verdicts", f"""WITH {EV}, g AS (SELECT user_id, count_if(event_type='purchase')::DOUBLE / count_if(event_type IN ('purchase','error','view')) AS p,
  count_if(event_type='error')::DOUBLE / count_if(event_type IN ('purchase','error','view')) AS e, count_if(event_type='view')::DOUBLE / count_if(event_type IN ('purchase','error','view')) AS v FROM ev GROUP BY user_id
  HAVING count_if(event_type IN ('purchase','error','view')) > 0),
o AS (SELECT *, CASE WHEN p >= e AND p >= v AND p >= 0.5 THEN 'made_fg' WHEN e > p AND e >= v AND e >= 0.5 THEN 'missed_fg' WHEN v > p AND v > e AND v >= 0.5 THEN 'turnover' ELSE 'unclear' END AS outcome FROM g)
SELECT user_id, outcome, CASE WHEN outcome = 'made_fg' AND p >= 0.6 AND p > 1.0 - p THEN 'entity_' || user_id END AS scorer, CASE WHEN outcome = 'made_fg' AND p >= 0.6 AND v >= 0.1 THEN user_id + 1 END AS assist FROM o""")
def _(t: Tables):
    e3 = F.col("event_type").isin("purchase", "error", "view")
    g = t.ev.filter(e3).groupBy("user_id").agg(*[(F.count_if(F.col("event_type") == e).cast("double") / F.count(F.lit(1))).alias(e)
                                               for e in ("purchase", "error", "view")])
    me = F.concat(F.lit("entity_"), F.col("user_id"))
    out = F.create_map(F.lit("made_fg"), F.col("purchase"), F.lit("missed_fg"), F.col("error"), F.lit("turnover"), F.col("view"))
    who = F.create_map(me, F.col("purchase"), F.lit("team_unattributed"), F.lit(1.0) - F.col("purchase"))
    v = decide.compose_verdict(out, who, F.when(F.col("view") >= 0.1, 1.0).otherwise(0.0), F.col("user_id") + 1, me, F.lit(0.0),
                               F.array().cast("array<string>"))
    return g.select("user_id", v["outcome"].alias("outcome"), v["scorer"].alias("scorer"), v["assist"].alias("assist"))


@query("fn28_what_if", f"""WITH {XY}, m AS (SELECT event_id, x, y, least(greatest(x + 6.0::DOUBLE, 0.0), 105.0::DOUBLE) AS sx, least(greatest(y - 8.0::DOUBLE, 0.0), 68.0::DOUBLE) AS sy FROM p)
SELECT event_id, sqrt((sx-105.0::DOUBLE)*(sx-105.0::DOUBLE)+(sy-34.0::DOUBLE)*(sy-34.0::DOUBLE)) - sqrt((x-105.0::DOUBLE)*(x-105.0::DOUBLE)+(y-34.0::DOUBLE)*(y-34.0::DOUBLE)) AS change FROM m""")
def _(t: Tables):
    from fieldtrace.operators.tracks import what_if
    goal = lambda a, b: G.dist(a, b, F.lit(105.0), F.lit(34.0))
    return what_if(xy(t), F.col("x"), F.col("y"), 6.0, -8.0, {"change": goal}).select("event_id", "change")


@query("fn29_plausible_end", f"""WITH {BOX}, c AS (SELECT l_orderkey, l_linenumber, (x1+x2)/2.0::DOUBLE AS cx, (y1+y2)/2.0::DOUBLE AS cy FROM b),
d AS (SELECT *, CASE WHEN abs(cx - 30.0::DOUBLE) <= 20 AND 120.0::DOUBLE - cy BETWEEN 20 AND 100 THEN abs(cx - 30.0::DOUBLE) END AS dl,
  CASE WHEN abs(cx - 70.0::DOUBLE) <= 20 AND 130.0::DOUBLE - cy BETWEEN 20 AND 100 THEN abs(cx - 70.0::DOUBLE) END AS dr FROM c)
SELECT l_orderkey, l_linenumber, CASE WHEN dl IS NULL AND dr IS NULL THEN NULL WHEN dr IS NULL OR dl <= dr THEN 'left' ELSE 'right' END AS "end" FROM d""")
def _(t: Tables):
    cx, cy = (F.col("x1") + F.col("x2")) / 2.0, (F.col("y1") + F.col("y2")) / 2.0
    e = G.plausible_end(cx, cy, {"left": (F.lit(30.0), F.lit(120.0)), "right": (F.lit(70.0), F.lit(130.0))},
                        F.lit(100.0), F.lit(200.0), 0.2, (0.1, 0.5))
    return boxes(t).select("l_orderkey", "l_linenumber", e.alias("end"))


@query("fn30_read_distribution", f"""WITH {EV}, n AS (SELECT user_id, count_if(event_type='click')::DOUBLE / count(*) AS a, count_if(event_type='view')::DOUBLE / count(*) AS b,
  count_if(event_type='purchase')::DOUBLE / count(*) AS c, count_if(event_type IN ('error','signup'))::DOUBLE / count(*) AS e FROM ev GROUP BY user_id)
SELECT user_id, CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS top,
  CASE WHEN greatest(a, b, c) >= 0.25 AND 1.0 - e >= 0.55 THEN 'provisional' ELSE 'abstain' END AS status FROM n""")
def _(t: Tables):
    e = F.col("event_type")
    n = t.ev.groupBy("user_id").agg(F.array(
        *[F.count_if(e == v).cast("double") / F.count(F.lit(1)) for v in ("click", "view", "purchase")],
        F.count_if(e.isin("error", "signup")).cast("double") / F.count(F.lit(1))).alias("p"))
    r = decide.read_distribution(F.col("p"), 0.25, 0.55)
    return n.select("user_id", r["top"].alias("top"), r["status"].alias("status"))


@query("fn30_read_digits")
def _(t: Tables):
    """Digit boxes per order read left to right; covered by literal tests."""
    d = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(
        "l_linenumber", (F.col("l_linenumber") % 10).cast("string").alias("label"), (F.lit(1.0) - F.col("l_discount") * 5).alias("score"),
        F.col("l_quantity").alias("x1"), F.lit(0.0).alias("y1"), (F.col("l_quantity") + 8.0).alias("x2"), F.lit(10.0).alias("y2")))).alias("digits"))
    r = decide.read_digits(F.col("digits"), 0.7, 0.5, 2)
    return d.select("l_orderkey", r["number"].alias("number"), r["reason"].alias("reason"))


@query("fn25_rounding")
def _(t: Tables):
    """Shares of a value at one and four places, as binary values round (tested against the interpreter's rounding)."""
    v = F.col("cents") / 700.0
    return t.ev.select("event_id", decide.round_binary(v, 1).alias("one"), decide.round_binary(v, 4).alias("four"))
