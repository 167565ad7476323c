"""Runs, transitions, spans and frames over the event stream (clock = microseconds, key = user)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtrace.operators import frames, islands
from fieldtrace.operators.ordered import scan, next_, prev, row_number
from fieldtrace.operators.metrics import quantiles
from fieldtrace.plans.registry import DAY, EV, HOUR, Tables, query

RUNS = f"""{EV}, mk AS (
  SELECT *, CASE WHEN event_type = lag(event_type) OVER w AND us - lag(us) OVER w <= {24 * HOUR}
            THEN 0 ELSE 1 END AS o
  FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us)),
rn AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY us) AS r FROM mk),
runs AS (SELECT user_id, r, min(event_type) AS event_type, min(us) AS "start", max(us) AS "end",
         count(*) AS n FROM rn GROUP BY user_id, r)"""


@query("win01_label_runs", f"""WITH {RUNS}
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY r) - 1 AS run_id, event_type,
       "start", "end", n FROM runs WHERE "end" - "start" >= {HOUR}""")
def _(t: Tables):
    """Runs of one event type per user, bridged over 24 h, kept when at least 1 h long."""
    return islands.label_runs(t.ev, ["user_id"], ["us"], "event_type", 24 * HOUR, HOUR)


@query("agg15_run_summary", f"""WITH {RUNS}
SELECT event_type, count(*) AS runs, CAST(sum(n) AS BIGINT) AS events, max(n) AS longest,
       median("end" - "start") AS median_us, count_if(n > 1) AS multi
FROM runs GROUP BY event_type""")
def _(t: Tables):
    runs = islands.label_runs(t.ev, ["user_id"], ["us"], "event_type", 24 * HOUR)
    med = quantiles(runs.withColumn("len", F.col("end") - F.col("start")), ["event_type"], "len",
                    {"median_us": (0.5, "linear")}).drop("n")
    return runs.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("runs"), F.sum("n").alias("events"), F.max("n").alias("longest"),
        F.count_if(F.col("n") > 1).alias("multi")).join(med, "event_type")


@query("win01_role_runs", """WITH mk AS (
  SELECT conv_id, turn, role, CASE WHEN role = lag(role) OVER w AND turn - lag(turn) OVER w <= 1
         THEN 0 ELSE 1 END AS o FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
rn AS (SELECT *, sum(o) OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM mk)
SELECT conv_id, r - 1 AS run_id, min(role) AS role, min(turn) AS "start", max(turn) AS "end", count(*) AS n
FROM rn GROUP BY conv_id, r""")
def _(t: Tables):
    return islands.label_runs(t.conversations, ["conv_id"], ["turn"], "role", 1)


@query("win04_live_spans", f"""WITH {EV}, mk AS (
  SELECT user_id, us, CASE WHEN us - lag(us) OVER w <= {12 * HOUR} THEN 0 ELSE 1 END AS o
  FROM ev WHERE event_type IN ('view', 'click') WINDOW w AS (PARTITION BY user_id ORDER BY us)),
rn AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY us) AS r FROM mk)
SELECT user_id, min(us) AS "start", max(us) AS "end", count(*) AS n FROM rn GROUP BY user_id, r
HAVING max(us) > min(us)""")
def _(t: Tables):
    reads = t.ev.filter(F.col("event_type").isin("view", "click"))
    return islands.live_spans(reads, ["user_id"], "us", 12 * HOUR)


@query("win04_complement_spans", f"""WITH {EV}, mk AS (
  SELECT user_id, us, CASE WHEN us - lag(us) OVER w <= {12 * HOUR} THEN 0 ELSE 1 END AS o
  FROM ev WHERE event_type IN ('view', 'click') WINDOW w AS (PARTITION BY user_id ORDER BY us)),
rn AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY us) AS r FROM mk),
sp AS (SELECT user_id, min(us) - {HOUR} AS s, max(us) + {HOUR} AS e FROM rn GROUP BY user_id, r
       HAVING max(us) > min(us)),
bd AS (SELECT user_id, min(us) AS lo, max(us) AS hi FROM ev GROUP BY user_id),
al AS (SELECT user_id, s, e FROM sp UNION ALL SELECT user_id, lo, lo FROM bd UNION ALL SELECT user_id, hi, hi FROM bd),
pv AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM al)
SELECT pv.user_id, greatest(m, lo) AS "start", least(s, hi) AS "end" FROM pv JOIN bd USING (user_id)
WHERE m IS NOT NULL AND least(s, hi) - greatest(m, lo) >= {HOUR}""")
def _(t: Tables):
    """Time outside every live span (padded by 1 h) within the user's active range."""
    reads = t.ev.filter(F.col("event_type").isin("view", "click"))
    spans = islands.live_spans(reads, ["user_id"], "us", 12 * HOUR)
    bounds = t.ev.groupBy("user_id").agg(F.min("us").alias("lo"), F.max("us").alias("hi"))
    return islands.complement_spans(spans, ["user_id"], bounds, HOUR, HOUR)


@query("win04_merge_intervals", """WITH sp AS (
  SELECT l_suppkey, epoch_us(l_shipdate) // 86400000000 AS s,
         epoch_us(l_shipdate) // 86400000000 + CAST(l_quantity AS BIGINT) AS e, l_orderkey, l_linenumber FROM lineitem),
pv AS (SELECT *, max(e) OVER (PARTITION BY l_suppkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM sp),
rn AS (SELECT *, sum(CASE WHEN m IS NULL OR s - m > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM pv)
SELECT l_suppkey, min(s) AS "start", max(e) AS "end", count(*) AS n FROM rn GROUP BY l_suppkey, g""")
def _(t: Tables):
    """Per supplier, union of shipping spans [day, day + quantity] with gaps up to a day bridged."""
    day = F.expr("unix_date(cast(l_shipdate as date))").cast("long")
    d = t.lineitem.select("l_suppkey", day.alias("s"), (day + F.col("l_quantity").cast("long")).alias("e"))
    return islands.merge_spans(d, ["l_suppkey"], "s", "e", 1)


@query("win05_transitions", f"""WITH {EV}, d AS (
  SELECT k % 10 AS court, us, event_id, user_id, event_type,
         lag(us) OVER w AS pt, lag(user_id) OVER w AS pa, lag(event_type) OVER w AS pm
  FROM ev WINDOW w AS (PARTITION BY k % 10 ORDER BY us)),
x AS (SELECT *, CASE WHEN pt IS NULL OR us - pt > {HOUR} THEN 'control_gain'
                WHEN pm = event_type THEN 'pass_candidate' ELSE 'steal_candidate' END AS kind
      FROM d WHERE pt IS NULL OR pa <> user_id)
SELECT court, us, event_id, user_id, event_type, kind, CASE WHEN kind <> 'control_gain' THEN pa END AS from_actor,
       CASE WHEN kind <> 'control_gain' THEN us - pt END AS gap FROM x""")
def _(t: Tables):
    d = t.ev.select((F.col("k") % 10).alias("court"), "us", "event_id", "user_id", "event_type")
    return islands.transitions(d, ["court"], ["us"], "user_id", "event_type", HOUR)


@query("win25_consecutive_distinct", f"""WITH {EV}, d AS (
  SELECT user_id, us, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY us) AS p FROM ev)
SELECT user_id, us, event_type FROM d WHERE p IS NULL OR p <> event_type""")
def _(t: Tables):
    return islands.consecutive_distinct(t.ev.select("user_id", "us", "event_type"), ["user_id"], ["us"], "event_type")


@query("win34_label_segments", f"""WITH {EV}, a AS (
  SELECT user_id, us, event_type, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY us) THEN 0 ELSE 1 END AS o FROM ev),
b AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY us) AS r FROM a),
c AS (SELECT user_id, r, min(event_type) AS event_type, min(us) AS t0, max(us) AS t1, count(*) AS n FROM b GROUP BY user_id, r HAVING count(*) >= 2),
d AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY r) THEN 0 ELSE 1 END AS o2 FROM c),
e AS (SELECT *, sum(o2) OVER (PARTITION BY user_id ORDER BY r) AS s FROM d),
f AS (SELECT user_id, s, min(event_type) AS event_type, min(t0) AS t0, max(t1) AS t1, sum(n) AS n FROM e GROUP BY user_id, s)
SELECT user_id, CAST(s - 1 AS BIGINT) AS segment, event_type,
       coalesce((lag(t1) OVER w + t0) // 2, t0) AS "start", coalesce((t1 + lead(t0) OVER w) // 2, t1) AS "end",
       CAST(n AS BIGINT) AS n FROM f WINDOW w AS (PARTITION BY user_id ORDER BY s)""")
def _(t: Tables):
    return islands.label_segments(t.ev, ["user_id"], ["us"], "event_type", 2)


@query("win14_carry_forward", f"""WITH {EV}, d AS (
  SELECT event_id, user_id, us, CASE WHEN event_type = 'purchase' THEN cents END AS price FROM ev),
f AS (SELECT *, last_value(price IGNORE NULLS) OVER w AS carried,
             last_value(CASE WHEN price IS NOT NULL THEN us END IGNORE NULLS) OVER w AS seen_at
      FROM d WINDOW w AS (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING))
SELECT event_id, user_id, us, price, carried,
       coalesce(least((us - seen_at) / {float(3 * DAY)!r}, 1.0), 1.0)::DOUBLE AS carried_age FROM f""")
def _(t: Tables):
    d = t.ev.select("event_id", "user_id", "us", F.when(F.col("event_type") == "purchase", F.col("cents")).alias("price"))
    return islands.carry_forward(d, ["user_id"], ["us"], "price", 3 * DAY, "carried")


@query("win40_densest_window", f"""WITH {EV}, c AS (
  SELECT user_id, us AS "start", count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN CURRENT ROW AND {2 * DAY - 1} FOLLOWING) AS n FROM ev)
SELECT user_id, "start", n FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, "start") = 1""")
def _(t: Tables):
    return frames.densest_window(t.ev.select("user_id", "us"), ["user_id"], "us", 2 * DAY)


@query("win41_rolling_median", f"""WITH {EV}
SELECT event_id, user_id, median(cents) OVER (PARTITION BY user_id ORDER BY us ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS smooth FROM ev""")
def _(t: Tables):
    d = frames.rows_frame(t.ev.select("event_id", "user_id", "us", "cents"), ["user_id"], ["us"], -2, 2,
                          {"_near": F.collect_list("cents")})
    s = F.array_sort("_near")
    n = F.size("_near")
    mid = F.when(n % 2 == 1, F.get(s, F.floor(n / 2).cast("int")).cast("double")).otherwise(
        (F.get(s, (n / 2).cast("int") - 1) + F.get(s, (n / 2).cast("int"))) / 2.0)
    return d.select("event_id", "user_id", mid.alias("smooth"))


@query("win41_scene_test", f"""WITH {EV}, c AS (SELECT event_id, user_id, us,
  count(*) OVER w AS n, max(k) OVER w AS top FROM ev
  WINDOW w AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN {DAY} PRECEDING AND {DAY} FOLLOWING))
SELECT event_id, user_id, n, n >= 5 AND top <= 90 AS scene_ok FROM c""")
def _(t: Tables):
    d = frames.range_frame(t.ev.select("event_id", "user_id", "us", "k"), ["user_id"], "us", -DAY, DAY,
                           {"n": F.count(F.lit(1)), "top": F.max("k")})
    return d.select("event_id", "user_id", "n", ((F.col("n") >= 5) & (F.col("top") <= 90)).alias("scene_ok"))


@query("win21_forward_gain", f"""WITH {EV}, c AS (
  SELECT event_id, user_id, us, cents, max(cents) OVER w AS best, count(*) OVER w AS seen,
         max(us) OVER (PARTITION BY user_id) AS stop
  FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN 1 FOLLOWING AND {2 * DAY} FOLLOWING))
SELECT event_id, user_id, CASE WHEN stop < us + {2 * DAY} OR seen = 0 THEN NULL
       WHEN best - cents >= 1000 THEN 1 ELSE 0 END AS label FROM c""")
def _(t: Tables):
    """Does the value rise by 10.00 within two days? Unknown when the record ends before that."""
    d = frames.range_frame(t.ev, ["user_id"], "us", 1, 2 * DAY, {"best": F.max("cents"), "seen": F.count(F.lit(1))})
    stop = t.ev.groupBy("user_id").agg(F.max("us").alias("stop"))
    d = d.join(stop, "user_id")
    label = F.when((F.col("stop") < F.col("us") + 2 * DAY) | (F.col("seen") == 0), F.lit(None)).when(
        F.col("best") - F.col("cents") >= 1000, 1).otherwise(0)
    return d.select("event_id", "user_id", label.cast("int").alias("label"))


@query("win43_next_ten_labels", f"""WITH {EV}
SELECT event_id, user_id, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER w AS scores,
       max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w AS concedes
FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)""")
def _(t: Tables):
    return frames.rows_frame(t.ev, ["user_id"], ["us"], 0, 9, {
        "scores": F.max(F.when(F.col("event_type") == "purchase", 1).otherwise(0)),
        "concedes": F.max(F.when(F.col("event_type") == "error", 1).otherwise(0)),
    }).select("event_id", "user_id", "scores", "concedes")


@query("win24_sliding_windows", f"""WITH {EV}, d AS (
  SELECT *, row_number() OVER w AS rn, lead(us, 3) OVER w AS last_us, lag(us, 4) OVER w AS first_us,
    list(cents) OVER (PARTITION BY user_id ORDER BY us ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS past,
    list(cents) OVER (PARTITION BY user_id ORDER BY us ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS future,
    greatest(us - lag(us) OVER w, 0) AS gap FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us)),
g AS (SELECT *, max(gap) OVER (PARTITION BY user_id ORDER BY us ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS worst FROM d)
SELECT event_id, user_id, past, future FROM g
WHERE len(past) = 5 AND len(future) = 3 AND (rn - 5) % 3 = 0 AND worst <= {36 * HOUR}""")
def _(t: Tables):
    """Past 5 / future 3 rows at stride 3, only where no gap inside exceeds 36 h."""
    d = scan(t.ev, ["user_id"], ["us"], {"_p": prev(F.col("us")), "_rn": row_number()})
    d = d.withColumn("gap", F.col("us") - F.col("_p"))
    d = frames.range_frame(d, ["user_id"], "_rn", -4, 0, {"past": F.collect_list("cents")})
    d = frames.range_frame(d, ["user_id"], "_rn", 1, 3, {"future": F.collect_list("cents")})
    d = frames.range_frame(d, ["user_id"], "_rn", -3, 3, {"worst": F.max("gap")})
    keep = (F.size("past") == 5) & (F.size("future") == 3) & ((F.col("_rn") - 5) % 3 == 0) & (F.col("worst") <= 36 * HOUR)
    return d.filter(keep).select("event_id", "user_id", "past", "future")


@query("win12_pass_through", f"""WITH {EV}, hit AS (
  SELECT user_id, count(*) AS n, min(CASE WHEN k >= 80 THEN us END) AS above,
         max(CASE WHEN k < 20 THEN us END) AS below FROM ev GROUP BY user_id)
SELECT user_id, n, CASE WHEN n < 3 OR above IS NULL THEN NULL WHEN below > above THEN true ELSE false END AS verdict FROM hit""")
def _(t: Tables):
    from fieldtrace.operators.grid import pass_through
    return pass_through(t.ev, ["user_id"], "us", F.col("k") >= 80, F.col("k") < 20)


@query("win38_frame_gaps", f"""WITH {EV}, d AS (
  SELECT event_id, user_id, us - lag(us) OVER w AS gap, event_type <> lag(event_type) OVER w AS cut FROM ev
  WINDOW w AS (PARTITION BY user_id ORDER BY us))
SELECT event_id, user_id, gap, coalesce(cut, false) AS cut FROM d""")
def _(t: Tables):
    d = scan(t.ev, ["user_id"], ["us"], {"_p": prev(F.struct("us", "event_type"))})
    return d.select("event_id", "user_id", (F.col("us") - F.col("_p.us")).alias("gap"),
                    F.coalesce(F.col("event_type") != F.col("_p.event_type"), F.lit(False)).alias("cut"))


@query("win38_longest_segment", f"""WITH {EV}, d AS (
  SELECT user_id, us, event_type, CASE WHEN event_type <> 'error' THEN event_type END AS team,
         lag(CASE WHEN event_type <> 'error' THEN event_type END) OVER w AS pt, lag(us) OVER w AS pu
  FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us)),
m AS (SELECT *, CASE WHEN team IS NULL OR pt IS NULL OR team <> pt OR us - pu > {48 * HOUR} THEN 1 ELSE 0 END AS o FROM d),
g AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY us) AS seg FROM m),
s AS (SELECT user_id, seg, min(team) AS team, min(us) AS t0, max(us) AS t1, count(*) AS n FROM g WHERE team IS NOT NULL GROUP BY user_id, seg)
SELECT user_id, team, t0, t1, n FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY t1 - t0 DESC, t0) = 1""")
def _(t: Tables):
    """Longest possession hypothesis per user; unknown rows, team changes and gaps break a segment."""
    from fieldtrace.operators.grid import longest_segment
    d = t.ev.withColumn("team", F.when(F.col("event_type") != "error", F.col("event_type")))
    return longest_segment(d, ["user_id"], "us", "team", 48 * HOUR)


def _vote(a, b, first):
    """SQL of the majority of two counts, at least two votes, first seen on a tie."""
    who = f"CASE WHEN greatest({a},{b}) >= 2 THEN CASE WHEN {a} > {b} THEN 0 WHEN {b} > {a} THEN 1 ELSE {first} END END"
    num = f"CASE WHEN greatest({a},{b}) >= 2 THEN greatest({a},{b}) ELSE 0 END"
    return who, num


_V = {"ml": _vote("l0", "l1", "fl"), "mr": _vote("r0", "r1", "fr"), "nl": _vote("tl0-l0", "tl1-l1", "gl"),
      "nr": _vote("tr0-r0", "tr1-r1", "gr"), "wl": _vote("tl0", "tl1", "fl"), "wr": _vote("tr0", "tr1", "fr")}


@query("win29_change_point", f"""WITH {EV}, d AS (
  SELECT user_id % 50 AS game, us, CASE WHEN k < 50 THEN 'left' ELSE 'right' END AS side, CASE WHEN cents < 3500 THEN 0 ELSE 1 END AS team FROM ev
  WHERE event_type = 'purchase'),
n AS (SELECT *, row_number() OVER w AS i, lead(us) OVER w AS nu,
  sum(CASE WHEN side='left' AND team=0 THEN 1 ELSE 0 END) OVER w AS l0, sum(CASE WHEN side='left' AND team=1 THEN 1 ELSE 0 END) OVER w AS l1,
  sum(CASE WHEN side='right' AND team=0 THEN 1 ELSE 0 END) OVER w AS r0, sum(CASE WHEN side='right' AND team=1 THEN 1 ELSE 0 END) OVER w AS r1,
  first_value(CASE WHEN side='left' THEN team END IGNORE NULLS) OVER (PARTITION BY game ORDER BY us ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS gl,
  first_value(CASE WHEN side='right' THEN team END IGNORE NULLS) OVER (PARTITION BY game ORDER BY us ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS gr
  FROM d WINDOW w AS (PARTITION BY game ORDER BY us)),
tt AS (SELECT game, max(l0) AS tl0, max(l1) AS tl1, max(r0) AS tr0, max(r1) AS tr1,
  arg_min(team, us) FILTER (side='left') AS fl, arg_min(team, us) FILTER (side='right') AS fr FROM n GROUP BY game),
s AS (SELECT n.*, {", ".join(f"{v[0]} AS {k}, {v[1]} AS c{k}" for k, v in _V.items())} FROM n JOIN tt USING (game)),
sc AS (SELECT *, CASE WHEN ml = mr THEN 0 ELSE cml + cmr END AS n1, CASE WHEN nl = nr THEN 0 ELSE cnl + cnr END AS n2,
  CASE WHEN wl = wr THEN 0 ELSE cwl + cwr END AS nw FROM s)
SELECT game, CAST(n1 + n2 AS BIGINT) AS explained, CAST(nw AS BIGINT) AS whole, (us + nu) // 2 AS cut FROM sc
WHERE nu IS NOT NULL AND n1 > 0 AND n2 > 0 AND (ml <> nl OR mr <> nr) AND n1 + n2 >= nw + 2
QUALIFY row_number() OVER (PARTITION BY game ORDER BY n1 + n2 DESC, i) = 1""")
def _(t: Tables):
    """One side switch per game: the cut between shots that explains most, if it gains at least two."""
    from fieldtrace.operators.grid import change_point
    d = t.ev.filter("event_type = 'purchase'").select(
        (F.col("user_id") % 50).alias("game"), "us", F.when(F.col("k") < 50, "left").otherwise("right").alias("side"),
        F.when(F.col("cents") < 3500, 0).otherwise(1).alias("team"))
    return change_point(d, ["game"], "us", "side", ("left", "right"), "team", 2, 2)
