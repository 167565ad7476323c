"""Detection and tracking reports on event boxes (a user's week is a frame), and orders paired with orders by names and dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtrace.operators import detection_eval, matching, reports
from fieldtrace.plans.registry import DAY, EV, Tables, query

WEEK = 7 * DAY
LIMITS = [x / 100 for x in range(50, 100, 5)]


def boxes(t: Tables):
    """Event boxes of three sizes; a click or an error is a prediction, a view or signup a truth."""
    k, e, y = F.col("k").cast("double"), F.col("event_id"), (F.col("cents") % 20).cast("double")
    big = F.when(e % 5 == 0, 4).when(e % 5 == 1, 2).otherwise(1)
    d = t.ev.select("event_id", "event_type", "k", (F.col("user_id") % 5).alias("seq"), F.concat_ws("-", "user_id", F.floor(F.col("us") / F.lit(WEEK))).alias("frame"), (F.col("user_id") % 3).alias("label"),
                    (k / 4).alias("x1"), y.alias("y1"), (k / 4 + 30 * big).alias("x2"), (y + 26 * big).alias("y2"), (F.floor(F.col("cents") / 500) / F.lit(100.0)).alias("score"))
    cols = ["x1", "y1", "x2", "y2"]
    truth = d.filter("event_type in ('view', 'signup')").select("seq", "frame", "label", F.col("event_id").alias("truth_id"), *cols)
    pred = d.filter("event_type in ('click', 'error')").select("seq", "frame", "label", F.col("event_id").alias("pred_id"), "score", *cols)
    ask = d.filter("event_type = 'purchase'")
    b = F.struct(*cols)
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    poly = F.array(corner(F.col("x1") - 3, F.col("y1") - 3), corner(F.col("x1") + 12, F.col("y1") - 3), corner(F.col("x1") + 12, F.col("y1") + 20))
    regions = ask.groupBy("seq", "frame").agg(F.collect_list(F.when(F.col("k") % 2 == 0, b)).alias("boxes"), F.collect_list(F.when(F.col("k") % 2 == 1, poly)).alias("polygons"))
    return pred, truth, regions, ask.filter(F.col("k") % 2 == 0).select("seq", "frame", *cols), d.select("seq", "frame").distinct()


def sql_iou(a, b, own=False):
    ix, iy = f"(least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1))", f"(least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1))"
    area = f"({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1)"
    union = area if own else f"({area} + ({b}.x2 - {b}.x1) * ({b}.y2 - {b}.y1) - {ix} * {iy})"
    return f"(CASE WHEN {ix} <= 0 OR {iy} <= 0 THEN 0.0::DOUBLE ELSE {ix} * {iy} / ({union}) END)"


SIZE = "CASE WHEN (x2 - x1) * (y2 - y1) < 1024 THEN 'small' WHEN (x2 - x1) * (y2 - y1) < 9216 THEN 'medium' ELSE 'large' END"
BOXES = f"""WITH RECURSIVE {EV}, b AS (SELECT event_id, event_type, k, user_id % 5 AS seq, user_id || '-' || (us // {WEEK}) AS frame, user_id % 3 AS label, k / 4.0::DOUBLE AS x1, (cents % 20)::DOUBLE AS y1,
  k / 4.0::DOUBLE + 30 * CASE event_id % 5 WHEN 0 THEN 4 WHEN 1 THEN 2 ELSE 1 END AS x2, (cents % 20)::DOUBLE + 26 * CASE event_id % 5 WHEN 0 THEN 4 WHEN 1 THEN 2 ELSE 1 END AS y2, (cents // 500) / 100.0::DOUBLE AS score FROM ev),
t AS (SELECT * FROM b WHERE event_type IN ('view', 'signup')), p AS (SELECT * FROM b WHERE event_type IN ('click', 'error')), ask AS (SELECT * FROM b WHERE event_type = 'purchase')"""


def greedy(pairs: str, order: str, passes: str) -> str:
    """Frames side by side, a pair a step: the state is what is taken in the frame."""
    return f"""o AS (SELECT *, row_number() OVER (PARTITION BY frame, label, limit_ ORDER BY {order}) AS i FROM {pairs} WHERE {passes}),
walk AS (SELECT frame, label, limit_, 0::BIGINT AS i, []::BIGINT[] AS ps, []::BIGINT[] AS ts, NULL::BIGINT AS pid, NULL::BIGINT AS tid, NULL::DOUBLE AS value FROM (SELECT DISTINCT frame, label, limit_ FROM o)
  UNION ALL SELECT walk.frame, walk.label, walk.limit_, o.i, CASE WHEN free THEN list_append(ps, o.pid) ELSE ps END, CASE WHEN free THEN list_append(ts, o.tid) ELSE ts END, CASE WHEN free THEN o.pid END, CASE WHEN free THEN o.tid END, o.value
  FROM walk JOIN o ON o.frame = walk.frame AND o.label = walk.label AND o.limit_ = walk.limit_ AND o.i = walk.i + 1, LATERAL (SELECT NOT list_contains(ps, o.pid) AND NOT list_contains(ts, o.tid) AS free)),
m AS (SELECT frame, label, limit_, pid, tid, value FROM walk WHERE pid IS NOT NULL)"""


def report_sql(value: str, limit: float, order: str, passes: str, errors: bool) -> str:
    mean = ", round(avg(error), 9) AS error_mean, quantile_cont(error, 0.5) AS error_median, quantile_disc(error, 0.95) AS error_p95" if errors else ""
    extra = ", error_mean, error_median, error_p95" if errors else ""
    return f"""{BOXES}, pr AS (SELECT p.frame, p.label, {limit}::DOUBLE AS limit_, p.event_id AS pid, t.event_id AS tid, p.score, {value} AS value FROM p JOIN t ON p.frame = t.frame AND p.label = t.label WHERE p.score >= 0.05),
{greedy('pr', order, passes)},
ib AS (SELECT DISTINCT p.event_id AS pid FROM p JOIN ask ON p.frame = ask.frame AND ask.k % 2 = 0 AND {sql_iou('p', 'ask')} >= 0.3),
ip AS (SELECT DISTINCT p.event_id AS pid FROM (SELECT *, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM p) p JOIN (SELECT frame, x1 - 3 AS ax, y1 - 3 AS ay, x1 + 12 AS bx, y1 + 20 AS by_ FROM ask WHERE k % 2 = 1) q ON p.frame = q.frame
  AND (((by_ > cy) <> (ay > cy) AND cx < (ax - bx) * (cy - by_) / (ay - by_) + bx)::INT + ((ay > cy) <> (by_ > cy) AND cx < (bx - bx) * (cy - ay) / (by_ - ay) + bx)::INT) % 2 = 1),
facts AS (SELECT label, seq, {SIZE} AS size, 1 AS gt, (m.tid IS NOT NULL)::INT AS tp, 0 AS predictions, 0 AS fp, 0 AS ignored, m.value AS error FROM t LEFT JOIN (SELECT tid, value FROM m) m ON m.tid = t.event_id
  UNION ALL SELECT label, seq, {SIZE}, 0, 0, 1, (m.pid IS NULL AND ib.pid IS NULL AND ip.pid IS NULL)::INT, (m.pid IS NULL AND (ib.pid IS NOT NULL OR ip.pid IS NOT NULL))::INT, NULL
  FROM p LEFT JOIN (SELECT pid FROM m) m ON m.pid = p.event_id LEFT JOIN ib ON ib.pid = p.event_id LEFT JOIN ip ON ip.pid = p.event_id WHERE score >= 0.05),
l AS (SELECT label::VARCHAR AS label, seq::VARCHAR AS s, * EXCLUDE (label, seq) FROM facts UNION ALL SELECT label::VARCHAR, 'all', * EXCLUDE (label, seq) FROM facts UNION ALL SELECT 'all', 'all', * EXCLUDE (label, seq) FROM facts),
z AS (SELECT * FROM l UNION ALL SELECT * REPLACE ('all' AS size) FROM l),
n AS (SELECT seq::VARCHAR AS s, count(DISTINCT frame) AS frames FROM b GROUP BY 1 UNION ALL SELECT 'all', count(DISTINCT frame) FROM b),
g AS (SELECT label, s, size, sum(gt)::BIGINT AS gt, sum(predictions)::BIGINT AS predictions, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(ignored)::BIGINT AS ignored{mean} FROM z GROUP BY ALL)
SELECT label, g.s AS by, size, frames, gt, predictions, tp, fp, gt - tp AS fn, ignored, tp / nullif(tp + fp, 0) AS precision, tp / nullif(gt, 0) AS recall, fp / frames AS fp_per_frame{extra} FROM g JOIN n ON g.s = n.s"""


@query("agg19_size_strata", report_sql(sql_iou("p", "t"), 0.3, "score DESC, pid, value DESC, tid", "value >= 0.3", False))
def _(t: Tables):
    """Matched by overlap; unmatched predictions are tested against ignored boxes and polygons."""
    pred, truth, regions, _, manifest = boxes(t)
    return detection_eval.detection_report(pred, truth, regions, manifest, ["seq", "frame"], "label", "seq", 0.05, 0.3)


CENTRES = "sqrt(((p.x1 + p.x2) / 2 - (t.x1 + t.x2) / 2) * ((p.x1 + p.x2) / 2 - (t.x1 + t.x2) / 2) + ((p.y1 + p.y2) / 2 - (t.y1 + t.y2) / 2) * ((p.y1 + p.y2) / 2 - (t.y1 + t.y2) / 2))"


@query("agg19_centre_errors", report_sql(CENTRES, 25.0, "score DESC, pid, value, tid", "value <= 25", True))
def _(t: Tables):
    """Matched by centre distance, with mean, median and 95th percentile of the matched errors."""
    pred, truth, regions, _, manifest = boxes(t)
    return detection_eval.detection_report(pred, truth, regions, manifest, ["seq", "frame"], "label", "seq", 0.05, 0.3, centre_px=25.0)


AP = f"""{BOXES}, top AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY frame, label ORDER BY score DESC, event_id) <= 100),
pr AS (SELECT p.frame, p.label, limit_, p.event_id AS pid, t.event_id AS tid, p.score, {sql_iou('p', 't')} AS value FROM top p JOIN t ON p.frame = t.frame AND p.label = t.label, (SELECT unnest({LIMITS}::DOUBLE[]) AS limit_)),
{greedy('pr', 'score DESC, pid, value DESC, tid DESC', 'value >= limit_')},
cr AS (SELECT p.event_id AS pid, max({sql_iou('p', 'ask', own=True)}) AS share FROM top p JOIN ask ON p.frame = ask.frame AND ask.k % 2 = 0 GROUP BY 1),
d AS (SELECT p.seq, p.label, p.frame, p.event_id, p.score, u.limit_, (m.pid IS NOT NULL)::INT AS hit, (m.pid IS NOT NULL OR coalesce(share, 0) < u.limit_)::INT AS counted FROM top p CROSS JOIN (SELECT unnest({LIMITS}::DOUBLE[]) AS limit_) u
  LEFT JOIN m ON m.pid = p.event_id AND m.limit_ = u.limit_ LEFT JOIN cr ON cr.pid = p.event_id),
c AS (SELECT label, limit_, hit, sum(hit) OVER w AS tp, sum(counted) OVER w AS n FROM d WINDOW w AS (PARTITION BY label, limit_ ORDER BY score DESC, seq, frame, event_id)),
totals AS (SELECT label, count(*) AS truths FROM t GROUP BY 1),
points AS (SELECT label, limit_, r, coalesce(max(tp / n) FILTER (WHERE 100 * tp >= r * truths AND hit = 1), 0) AS best FROM c JOIN totals USING (label), range(0, 101) q(r) GROUP BY ALL),
ap AS (SELECT label, limit_, sum(best ORDER BY r) / 101 AS ap FROM points GROUP BY ALL)"""


@query("agg20_coco_precision", f"{AP} SELECT totals.label, u.limit_ AS threshold, truths, round(coalesce(ap, 0), 9) AS ap FROM totals CROSS JOIN (SELECT unnest({LIMITS}::DOUBLE[]) AS limit_) u LEFT JOIN ap ON ap.label = totals.label AND ap.limit_ = u.limit_")
def _(t: Tables):
    pred, truth, _, crowds, _ = boxes(t)
    return detection_eval.precision_table(pred, truth, crowds, ["seq", "frame"], "label").withColumn("ap", F.round("ap", 9))


@query("agg20_mean_precision", f"""{AP}, e AS (SELECT label::VARCHAR AS label, avg(ap) AS a, max(ap) FILTER (WHERE limit_ = 0.5) AS b, max(ap) FILTER (WHERE limit_ = 0.75) AS c FROM ap GROUP BY 1)
SELECT label, round(a, 9) AS map, round(b, 9) AS ap50, round(c, 9) AS ap75 FROM e UNION ALL SELECT 'all', round(avg(a), 9), round(avg(b), 9), round(avg(c), 9) FROM e""")
def _(t: Tables):
    pred, truth, _, crowds, _ = boxes(t)
    return detection_eval.mean_precision(detection_eval.precision_table(pred, truth, crowds, ["seq", "frame"], "label"), "label")


def tracks(t: Tables):
    pred, truth, _, _, _ = boxes(t)
    truth = truth.select("seq", "frame", "label", (F.col("truth_id") % 9).alias("gt"), "x1", "y1", "x2", "y2").dropDuplicates(["seq", "frame", "label", "gt"])
    pred = pred.select("seq", "frame", "label", (F.col("pred_id") % 7).alias("tr"), "x1", "y1", "x2", "y2").dropDuplicates(["seq", "frame", "label", "tr"])
    return truth, pred, truth.select("seq", "frame", "label").distinct().withColumn("exhaustive", F.lit(True))


@query("agg21_reviewed_tracking")
def _(t: Tables):
    """Scores per sequence and class on reviewed frames; which of two boxes of an identity stays is free, so the sums have their own query."""
    truth, pred, reviewed = tracks(t)
    return reports.reviewed_tracking(truth, pred, reviewed, ["seq"], "frame", "label", [0.05 * i for i in range(1, 20)])


@query("agg21_reviewed_sums", f"""{BOXES}, cover AS (SELECT DISTINCT seq, frame, label FROM t), g AS (SELECT DISTINCT seq, frame, label, event_id % 9 AS gt FROM t), r AS (SELECT DISTINCT seq, frame, label, event_id % 7 AS tr FROM p SEMI JOIN cover USING (seq, frame, label))
SELECT c.seq, c.label, c.frames, coalesce(g.n, 0) AS truth_boxes, coalesce(r.n, 0) AS pred_boxes, coalesce(g.n, 0) AS id_truth, coalesce(r.n, 0) AS id_pred FROM (SELECT seq, label, count(*) AS frames FROM cover GROUP BY ALL) c
LEFT JOIN (SELECT seq, label, count(*) AS n FROM g GROUP BY ALL) g ON g.seq = c.seq AND g.label = c.label LEFT JOIN (SELECT seq, label, count(*) AS n FROM r GROUP BY ALL) r ON r.seq = c.seq AND r.label = c.label""")
def _(t: Tables):
    """Whatever is assigned, identities found and missed add up to the boxes."""
    truth, pred, reviewed = tracks(t)
    d = reports.reviewed_tracking(truth, pred, reviewed, ["seq"], "frame", "label", [0.5])
    return d.select("seq", "label", "frames", "truth_boxes", "pred_boxes", (F.col("idtp") + F.col("idfn")).alias("id_truth"), (F.col("idtp") + F.col("idfp")).alias("id_pred"))


def named_orders(t: Tables):
    """An order names its customer's and its first line's supplier group; a supplier group stands for several nations."""
    first = t.lineitem.groupBy("l_orderkey").agg(F.min("l_suppkey").alias("supp"), F.max("l_suppkey").alias("other"))
    o = t.orders.join(first, F.col("o_orderkey") == F.col("l_orderkey")).withColumn("day", F.to_date("o_orderdate"))
    name = lambda c: F.concat(F.lit("s"), F.floor(c / 3).cast("string"))
    items = o.select(F.col("o_orderkey").alias("item"), F.when(F.col("o_orderkey") % 17 != 0, name(F.col("supp"))).alias("name_a"), name(F.col("other")).alias("name_b"),
                     F.when(F.col("o_custkey") % 101 != 0, F.date_sub("day", 3)).alias("lo"), F.date_add("day", 4).alias("hi"))
    names = t.supplier.select(name(F.col("s_suppkey")).alias("name"), F.col("s_nationkey").cast("long").alias("place"))
    events = o.select(F.col("o_orderkey").alias("event"), (F.col("o_custkey") % 25).alias("place_a"), (F.floor(F.col("o_orderkey") / 4) % 25).alias("place_b"), F.col("day").alias("date"), (F.col("o_orderkey") % 5 != 0).alias("complete"))
    return items, names, events


NAMED = """first AS (SELECT l_orderkey, min(l_suppkey) AS supp, max(l_suppkey) AS other FROM lineitem GROUP BY 1), o AS (SELECT *, o_orderdate::DATE AS day FROM orders JOIN first ON o_orderkey = l_orderkey),
i AS (SELECT o_orderkey AS item, CASE WHEN o_orderkey % 17 <> 0 THEN 's' || (supp // 3) END AS a, 's' || (other // 3) AS b, CASE WHEN o_custkey % 101 <> 0 THEN day - 3 END AS lo, day + 4 AS hi FROM o),
n AS (SELECT DISTINCT 's' || (s_suppkey // 3) AS name, s_nationkey AS place FROM supplier), e AS (SELECT o_orderkey AS event, o_custkey % 25 AS pa, (o_orderkey // 4) % 25 AS pb, day FROM o),
c AS (SELECT DISTINCT item, event FROM i JOIN n x ON x.name = a JOIN n y ON y.name = b JOIN e ON (pa = x.place AND pb = y.place) OR (pa = y.place AND pb = x.place) WHERE day <= hi AND (lo IS NULL OR day >= lo))"""


@query("join15_candidates", f"WITH {NAMED} SELECT i.item, c.event FROM i LEFT JOIN c ON c.item = i.item")
def _(t: Tables):
    """Orders whose two places an order names, in a window of a week or, without a start, up to its end."""
    return matching.pairing_candidates(*named_orders(t), "item", "event")


@query("join15_pairing")
def _(t: Tables):
    """Candidates and elimination together; a third of the events is taken before."""
    items, names, events = named_orders(t)
    return matching.pair_items(items, names, events, "item", "event", events.filter(F.col("event") % 3 == 0))


@query("agg34_chain_churn", f"""WITH RECURSIVE {EV}, b AS (SELECT event_id, user_id, us // {2 * DAY} AS d, k % 4 AS track, (k // 4)::DOUBLE AS x1, (cents % 20)::DOUBLE AS y1, (k // 4)::DOUBLE + 30 AS x2, (cents % 20)::DOUBLE + 26 AS y2 FROM ev),
nx AS (SELECT user_id, d, lead(d) OVER (PARTITION BY user_id ORDER BY d) AS nd FROM (SELECT DISTINCT user_id, d FROM b)),
pr AS (SELECT p.user_id || '-' || p.d AS frame, 0 AS label, 0.5::DOUBLE AS limit_, p.event_id AS pid, t.event_id AS tid, {sql_iou('p', 't')} AS value FROM b p JOIN nx ON nx.user_id = p.user_id AND nx.d = p.d JOIN b t ON t.user_id = p.user_id AND t.d = nd),
{greedy('pr', 'value DESC, pid, tid', 'value >= 0.5')},
ch AS (SELECT event_id AS node, event_id AS root FROM b WHERE event_id NOT IN (SELECT tid FROM m) UNION ALL SELECT m.tid, root FROM ch JOIN m ON m.pid = node),
fl AS (SELECT ch.root, count_if(p.track <> t.track) AS f FROM m JOIN ch ON ch.node = m.pid JOIN b p ON p.event_id = m.pid JOIN b t ON t.event_id = m.tid GROUP BY 1),
c AS (SELECT b.user_id, ch.root, count(*) AS n, coalesce(any_value(f), 0) AS f FROM ch JOIN b ON b.event_id = ch.node LEFT JOIN fl ON fl.root = ch.root GROUP BY ALL),
g AS (SELECT user_id, count(*) AS chains, count_if(n >= 3) AS long_chains, count_if(n >= 3 AND f > 0) AS flipped, coalesce(sum(f) FILTER (WHERE n >= 3), 0)::BIGINT AS flips, coalesce(max(f) FILTER (WHERE n >= 3), 0) AS most_flips FROM c GROUP BY 1)
SELECT *, flipped / greatest(long_chains, 1) AS flip_rate, flips / greatest(long_chains, 1) AS flips_per_chain FROM g""")
def _(t: Tables):
    """A user's two days are a frame; boxes are chained over frames, tracks are a number's remainder."""
    k, y = F.floor(F.col("k") / 4).cast("double"), (F.col("cents") % 20).cast("double")
    d = t.ev.select("user_id", F.floor(F.col("us") / F.lit(2 * DAY)).alias("d"), "event_id", (F.col("k") % 4).alias("track"), k.alias("x1"), y.alias("y1"), (k + 30).alias("x2"), (y + 26).alias("y2"))
    return detection_eval.chain_churn(d, ["user_id"], "d", "event_id", "track", 0.5, 3)
