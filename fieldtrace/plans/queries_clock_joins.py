"""As-of, nearest and interval joins over events, orders and lineitems."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtrace.operators import asof, interval
from fieldtrace.plans.registry import DAY, EV, HOUR, Tables, micros, query


def kind(t: Tables, *types: str):
    return t.ev.filter(F.col("event_type").isin(*types))


@query("join03_asof_backward", f"""WITH {EV}
SELECT p.event_id, p.user_id, p.us, CASE WHEN p.us - c.us <= {DAY} THEN c.event_id END AS click_id
FROM (SELECT * FROM ev WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM ev WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.us >= c.us""")
def _(t: Tables):
    """Each purchase with the user's last click in the 24 h before."""
    return asof.asof_join(kind(t, "purchase").select("event_id", "user_id", "us"), kind(t, "click"),
                          ["user_id"], "us", "us", {"click_id": "event_id"}, tolerance=DAY)


@query("join03_asof_forward", f"""WITH {EV}
SELECT p.event_id, p.user_id, p.us, CASE WHEN e.us - p.us <= {DAY} THEN e.event_id END AS error_id
FROM (SELECT * FROM ev WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM ev WHERE event_type = 'error') e ON p.user_id = e.user_id AND p.us < e.us""")
def _(t: Tables):
    return asof.asof_join(kind(t, "purchase").select("event_id", "user_id", "us"), kind(t, "error"),
                          ["user_id"], "us", "us", {"error_id": "event_id"}, "forward", DAY, allow_equal=False)


@query("join02_nearest_both_ways", f"""WITH {EV}, b AS (
  SELECT e.event_id, e.user_id, e.us, v.event_id AS bid, v.us AS bus FROM (SELECT * FROM ev WHERE event_type='error') e
  ASOF LEFT JOIN (SELECT * FROM ev WHERE event_type='view') v ON e.user_id = v.user_id AND e.us >= v.us),
f AS (SELECT b.*, v.event_id AS fid, v.us AS fus FROM b
  ASOF LEFT JOIN (SELECT * FROM ev WHERE event_type='view') v ON b.user_id = v.user_id AND b.us < v.us),
p AS (SELECT *, CASE WHEN bus IS NOT NULL AND (fus IS NULL OR us - bus <= fus - us) THEN bid ELSE fid END AS v,
             CASE WHEN bus IS NOT NULL AND (fus IS NULL OR us - bus <= fus - us) THEN bus - us ELSE fus - us END AS g FROM f)
SELECT event_id, user_id, us, CASE WHEN abs(g) <= {6 * HOUR} THEN v END AS view_id, CASE WHEN abs(g) <= {6 * HOUR} THEN g END AS gap FROM p""")
def _(t: Tables):
    return asof.nearest_join(kind(t, "error").select("event_id", "user_id", "us"), kind(t, "view"),
                             ["user_id"], "us", "us", {"view_id": "event_id"}, 6 * HOUR)


@query("join14_nearest_value", """WITH o AS (SELECT o_orderkey, o_orderpriority AS period, CAST(round(o_totalprice*100) AS BIGINT) AS c, o_orderstatus FROM orders),
u AS (SELECT period, c, min(o_orderkey) AS ref FROM o WHERE o_orderstatus = 'F' GROUP BY period, c),
l AS (SELECT * FROM o WHERE o_orderstatus = 'P'),
b AS (SELECT l.o_orderkey, l.period, l.c, u.ref AS bid, u.c AS bc FROM l ASOF LEFT JOIN u ON l.period = u.period AND l.c >= u.c),
f AS (SELECT b.*, u.ref AS fid, u.c AS fc FROM b ASOF LEFT JOIN u ON b.period = u.period AND b.c < u.c),
p AS (SELECT *, CASE WHEN bc IS NOT NULL AND (fc IS NULL OR c - bc <= fc - c) THEN bid ELSE fid END AS v,
             CASE WHEN bc IS NOT NULL AND (fc IS NULL OR c - bc <= fc - c) THEN bc - c ELSE fc - c END AS g FROM f)
SELECT o_orderkey, period, c, CASE WHEN abs(g) <= 2500 THEN v END AS ref, CASE WHEN abs(g) <= 2500 THEN g END AS gap FROM p""")
def _(t: Tables):
    """Pending orders with the filled order of the same priority nearest in price (within 25.00)."""
    o = t.orders.select("o_orderkey", F.col("o_orderpriority").alias("period"),
                        F.round(F.col("o_totalprice") * 100).cast("long").alias("c"), "o_orderstatus")
    ref = o.filter("o_orderstatus = 'F'").groupBy("period", "c").agg(F.min("o_orderkey").alias("ref"))
    left = o.filter("o_orderstatus = 'P'").select("o_orderkey", "period", "c")
    return asof.nearest_join(left, ref, ["period"], "c", "c", {"ref": "ref"}, 2500)


SPANS = """sp AS (SELECT s.event_id AS span_id, s.user_id, s.us AS t0, p.us AS t1, s.k AS label
  FROM (SELECT * FROM ev WHERE event_type='signup') s
  ASOF JOIN (SELECT * FROM ev WHERE event_type='purchase') p ON s.user_id = p.user_id AND s.us < p.us)"""


def spans(t: Tables):
    """Signup-to-next-purchase spans of each user (they may overlap)."""
    d = asof.asof_join(kind(t, "signup"), kind(t, "purchase"), ["user_id"], "us", "us", {"t1": "us"}, "forward",
                       allow_equal=False).filter("t1 is not null")
    return d.select(F.col("event_id").alias("span_id"), "user_id", F.col("us").alias("t0"), "t1",
                    F.col("k").alias("label"))


def views(t: Tables):
    return kind(t, "view", "click", "error").select("event_id", "user_id", "us")


@query("join04_first_containing", f"""WITH {EV}, {SPANS}
SELECT v.event_id, v.user_id, v.us, (SELECT arg_min(span_id, t0) FROM sp WHERE sp.user_id = v.user_id AND v.us BETWEEN t0 AND t1) AS span_id
FROM ev v WHERE event_type IN ('view','click','error')""")
def _(t: Tables):
    return interval.first_containing(views(t), spans(t), ["user_id"], ["event_id"], "us", "t0", "t1",
                                     ["span_id"], ["t0", "span_id"], DAY)


@query("join05_containing_else_last", f"""WITH {EV}, {SPANS}, v AS (SELECT event_id, user_id, us FROM ev WHERE event_type IN ('view','click','error')),
a AS (SELECT v.*, (SELECT arg_min(span_id, t0) FROM sp WHERE sp.user_id = v.user_id AND v.us BETWEEN t0 AND t1) AS i,
  (SELECT max(t1) FROM sp WHERE sp.user_id = v.user_id AND t1 < v.us) AS e FROM v),
b AS (SELECT a.*, coalesce(i, (SELECT min(span_id) FROM sp WHERE sp.user_id = a.user_id AND sp.t1 = a.e)) AS span_id FROM a)
SELECT b.event_id, b.user_id, b.us, sp.label, b.span_id, i IS NOT NULL AS inside FROM b LEFT JOIN sp ON sp.span_id = b.span_id""")
def _(t: Tables):
    return interval.containing_else_last(views(t), spans(t), ["user_id"], ["event_id"], "us", "t0", "t1",
                                         "label", "span_id", DAY)


@query("join06_nearest_span", f"""WITH {EV}, {SPANS}, v AS (SELECT event_id, user_id, us FROM ev WHERE event_type IN ('view','click','error')),
b AS (SELECT v.*, sp.span_id AS bi, greatest(v.us - sp.t1, 0) AS bd FROM v ASOF LEFT JOIN sp ON v.user_id = sp.user_id AND v.us >= sp.t0),
f AS (SELECT b.*, sp.span_id AS fi, sp.t0 - b.us AS fd FROM b ASOF LEFT JOIN sp ON b.user_id = sp.user_id AND b.us < sp.t0),
p AS (SELECT *, CASE WHEN bi IS NOT NULL AND (fi IS NULL OR bd <= fd) THEN bi ELSE fi END AS s,
             CASE WHEN bi IS NOT NULL AND (fi IS NULL OR bd <= fd) THEN bd ELSE fd END AS d FROM f)
SELECT event_id, user_id, us, CASE WHEN d <= {12 * HOUR} THEN s END AS span_id, CASE WHEN d <= {12 * HOUR} THEN d END AS distance FROM p""")
def _(t: Tables):
    return asof.nearest_span(views(t), spans(t), ["user_id"], "us", "t0", "t1", {"span_id": "span_id"}, 12 * HOUR)


@query("join07_padded_latest", f"""WITH {EV}, {SPANS}, c AS (
  SELECT sp.span_id, e.event_id, greatest(t0 - e.us, e.us - t1, 0) AS d, e.us FROM sp JOIN ev e ON e.user_id = sp.user_id
  AND e.event_type = 'click' AND e.us BETWEEN t0 - {12 * HOUR} AND t1 + {12 * HOUR}),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY span_id ORDER BY d, us DESC) = 1)
SELECT sp.span_id, sp.user_id, t0, t1, label, b.event_id, b.d AS distance FROM sp LEFT JOIN b ON b.span_id = sp.span_id""")
def _(t: Tables):
    return interval.padded_latest(spans(t), kind(t, "click").select("user_id", "us", "event_id"), ["user_id"],
                                  ["span_id"], "t0", "t1", "us", ["event_id"], 12 * HOUR, DAY)


@query("join08_attach_slack", f"""WITH {EV}, {SPANS}
SELECT sp.span_id, e.event_id FROM sp JOIN ev e ON e.user_id = sp.user_id AND e.event_type = 'error'
  AND e.us BETWEEN t0 - {2 * HOUR} AND t1 + {2 * HOUR}""")
def _(t: Tables):
    return interval.attach_in_slack(spans(t), kind(t, "error").select("user_id", "us", "event_id"), ["user_id"],
                                    "t0", "t1", "us", 2 * HOUR, DAY).select("span_id", "event_id")


@query("join08_order_windows", f"""SELECT o_orderkey, l_linenumber, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey
  AND l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 90 DAY GROUP BY 1, 2""")
def _(t: Tables):
    o = t.orders.select("o_orderkey", micros("o_orderdate").alias("t0"))
    o = o.withColumn("t1", F.col("t0") + 90 * DAY)
    items = t.lineitem.select("l_orderkey", "l_linenumber", micros("l_shipdate").alias("ship"))
    # the key itself bounds the pairs here, so a plain equi join with a filter is enough
    j = items.join(o, F.col("l_orderkey") == F.col("o_orderkey")).filter("ship between t0 and t1")
    return j.groupBy("o_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))


@query("join30_span_supply", f"""WITH {EV}, {SPANS}, w AS (SELECT event_id, user_id, us AS w0, us + {12 * HOUR} AS w1 FROM ev WHERE event_type = 'error'),
p AS (SELECT w.event_id, max(least(w1, t1) - greatest(w0, t0)) AS bo, count(*) AS n FROM w JOIN sp ON sp.user_id = w.user_id
  AND least(w1, t1) - greatest(w0, t0) > 0 GROUP BY w.event_id)
SELECT w.event_id, w.user_id, w0, w1, coalesce(bo, 0) AS best_overlap, coalesce(n, 0) AS n_spans, bo IS NOT NULL AS any_overlap,
  coalesce(bo >= (w1 - w0) * 0.8, false) AS covered FROM w LEFT JOIN p USING (event_id)""")
def _(t: Tables):
    w = kind(t, "error").select("event_id", "user_id", F.col("us").alias("w0"), (F.col("us") + 12 * HOUR).alias("w1"))
    return interval.span_supply(w, spans(t), ["user_id"], ["event_id"], ("w0", "w1"), ("t0", "t1"), DAY, 0.8)


@query("join19_asof_revision", f"""WITH {EV}, r AS (SELECT user_id, us AS r0, us + {2 * DAY} AS r1, k AS val, event_id AS revision FROM ev WHERE event_type = 'signup')
SELECT v.event_id, v.user_id, v.us, (SELECT list(val ORDER BY revision) FROM r WHERE r.user_id = v.user_id AND v.us >= r0 AND v.us < r1) AS alternatives,
 (SELECT arg_max(val, revision) FROM r WHERE r.user_id = v.user_id AND v.us >= r0 AND v.us < r1) AS selected,
 (SELECT max(revision) FROM r WHERE r.user_id = v.user_id AND v.us >= r0 AND v.us < r1) AS revision
FROM ev v WHERE event_type IN ('view','click','error')""")
def _(t: Tables):
    """Signups act as reviews valid for two days; the last revision is selected, all are listed."""
    r = kind(t, "signup").select("user_id", F.col("us").alias("r0"), (F.col("us") + 2 * DAY).alias("r1"),
                                 F.col("k").alias("val"), F.col("event_id").alias("revision"))
    return interval.asof_revision(views(t), r, ["user_id"], ["event_id"], "us", "r0", "r1", "val", "revision", 2 * DAY)


@query("join25_attempt_outcome", f"""WITH {EV}, d AS (SELECT event_id, user_id, us, event_type,
  lead(event_id) OVER w AS nid, lead(event_type) OVER w AS nt FROM ev WHERE event_type IN ('signup','purchase')
  WINDOW w AS (PARTITION BY user_id ORDER BY us))
SELECT event_id, user_id, us, CASE WHEN nt = 'purchase' THEN nid END AS outcome_id FROM d WHERE event_type = 'signup'""")
def _(t: Tables):
    return asof.pair_outcomes(t.ev.select("event_id", "user_id", "us", "event_type"), ["user_id"], ["us"],
                              F.col("event_type") == "signup", F.col("event_type") == "purchase",
                              {"outcome_id": "event_id"}).drop("event_type")


@query("join26_corroborated", f"""WITH {EV}
SELECT a.event_id, a.user_id, count(b.event_id) AS supporters, count(b.event_id) >= 2 AS kept FROM ev a
LEFT JOIN ev b ON a.user_id = b.user_id AND a.event_id <> b.event_id AND abs(a.us - b.us) <= {12 * HOUR} AND abs(a.k - b.k) <= 30
GROUP BY 1, 2""")
def _(t: Tables):
    """Rows of the same user within 12 h and 30 units support each other; two supporters keep a row."""
    d = t.ev.select("event_id", "user_id", "us", "k")
    pairs = interval.neighbours_within(d, ["user_id"], "event_id", "us", 12 * HOUR, ["k"])
    n = pairs.filter(F.abs(F.col("k") - F.col("_k")) <= 30).groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))
    return d.join(n, "event_id", "left").select(
        "event_id", "user_id", F.coalesce("n", F.lit(0)).alias("supporters"), (F.coalesce("n", F.lit(0)) >= 2).alias("kept"))


@query("win23_next_action", f"""WITH {EV}, a AS (SELECT event_id, user_id, us, us + {DAY} AS lim FROM ev WHERE event_type = 'view')
SELECT a.event_id, a.user_id, a.us, lim, CASE WHEN e.us <= lim THEN e.event_type END AS action, CASE WHEN e.us <= lim THEN e.event_id END AS action_id
FROM a ASOF LEFT JOIN (SELECT * FROM ev WHERE event_type IN ('click','purchase','error')) e ON a.user_id = e.user_id AND a.us < e.us""")
def _(t: Tables):
    """First click, purchase or error in the 24 h after each view."""
    a = kind(t, "view").select("event_id", "user_id", "us", (F.col("us") + DAY).alias("lim"))
    rows = kind(t, "click", "purchase", "error").select("user_id", F.col("us").alias("at"), F.col("event_type").alias("act"),
                                                        F.col("event_id").alias("act_id"))
    return interval.first_after(a, rows, ["user_id"], ["event_id"], "us", "lim", "at",
                                {"action": "act", "action_id": "act_id"}, DAY)


@query("agg45_follow_up", f"""WITH {EV}, {SPANS}, s AS (SELECT event_id, user_id, us FROM ev WHERE event_type = 'signup'),
i AS (SELECT s.event_id, s.user_id, s.us, sp.span_id, sp.t1, least(sp.t1, s.us + {10 * HOUR}) AS lim FROM s LEFT JOIN sp ON sp.user_id = s.user_id AND sp.t0 BETWEEN s.us AND s.us + {HOUR})
SELECT event_id, user_id, count(DISTINCT span_id) AS intervals, coalesce(bool_or(EXISTS (SELECT 1 FROM ev e WHERE e.user_id = i.user_id AND e.event_type = 'purchase' AND e.us > i.us AND e.us <= i.lim)), false) AS followed
FROM i GROUP BY 1, 2""")
def _(t: Tables):
    """Does a span opening within an hour of the restart contain a purchase within ten hours of it?"""
    s = kind(t, "signup").select("event_id", "user_id", "us")
    slots = s.select("user_id", F.col("event_id").alias("sid"), F.col("us").alias("s0"), (F.col("us") + HOUR).alias("s1"))
    opened = interval.span_pairs(spans(t), slots, ["user_id"], "t0", "s0", "s1", DAY, max_length=DAY)
    opened = opened.select("user_id", "sid", "span_id", "s0", F.least("t1", F.col("s0") + 10 * HOUR).alias("lim"))
    buys = kind(t, "purchase").select("user_id", F.col("us").alias("at"), F.col("event_id").alias("buy"))
    hit = interval.first_after(opened, buys, ["user_id"], ["sid", "span_id"], "s0", "lim", "at", {"buy": "buy"}, DAY)
    agg = hit.groupBy("sid").agg(F.count_distinct("span_id").alias("intervals"), F.max(F.col("buy").isNotNull()).alias("followed"))
    return s.join(agg, s.event_id == agg.sid, "left").select(
        "event_id", "user_id", F.coalesce("intervals", F.lit(0)).alias("intervals"),
        F.coalesce("followed", F.lit(False)).alias("followed"))


@query("win26_assist", f"""WITH {EV}, c AS (SELECT k % 10 AS court, us, user_id AS actor, user_id % 2 AS team FROM ev),
p AS (SELECT *, lag(actor) OVER w AS pa, lag(team) OVER w AS pm, lag(us) OVER w AS pt FROM c WINDOW w AS (PARTITION BY court ORDER BY us)),
r AS (SELECT *, sum(CASE WHEN pa IS NULL OR pa <> actor THEN 1 ELSE 0 END) OVER (PARTITION BY court ORDER BY us) AS run FROM p),
h AS (SELECT court, run, arg_min(team, us) AS m, min(us) AS t, arg_min(pa, us) AS pa, arg_min(pm, us) AS pm, arg_min(pt, us) AS pt FROM r GROUP BY court, run),
s AS (SELECT event_id, k % 10 AS court, us, user_id AS actor FROM ev WHERE event_type = 'purchase'),
j AS (SELECT s.*, r.actor AS la, h.t, h.m, h.pa, h.pm, h.pt FROM s JOIN r ON r.court = s.court AND r.us = s.us JOIN h ON h.court = r.court AND h.run = r.run),
o AS (SELECT *, coalesce(la = actor AND us - t <= {4 * HOUR} AND pa IS NOT NULL AND pm = m AND t - pt <= {2 * HOUR}, false) AS ok FROM j)
SELECT event_id, court, us, actor, CASE WHEN ok THEN pa END AS passer, CASE WHEN ok THEN pt END AS pass_t FROM o""")
def _(t: Tables):
    c = t.ev.select((F.col("k") % 10).alias("court"), "us", F.col("user_id").alias("actor"), (F.col("user_id") % 2).alias("team"))
    s = kind(t, "purchase").select("event_id", (F.col("k") % 10).alias("court"), "us", F.col("user_id").alias("actor"))
    return asof.assist(c, s, ["court"], "us", "actor", "team", 4 * HOUR, 2 * HOUR)
