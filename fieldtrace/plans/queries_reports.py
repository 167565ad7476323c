"""Detection, tracking and attribution reports, table functions and verdict jobs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldtrace.operators import reports, votes
from fieldtrace.operators.ordered import row_number, scan
from fieldtrace.operators.pairs import bridge_by_time
from fieldtrace.plans import hoops
from fieldtrace.plans.queries_pairs import EB, event_boxes, right_boxes, sql_iou
from fieldtrace.plans.registry import DAY, EV, HOUR, Tables, query
from fieldtrace.sources import stage


@query("agg05_bridged_labels", f"""WITH {EB}, p AS (SELECT a.user_id, a.event_id, b.event_id AS rid, {sql_iou('a', 'b')} AS iou, b.k % 2 AS label FROM eb a JOIN eb b ON a.user_id=b.user_id AND a.event_type='view' AND b.event_type='click' AND b.us >= a.us - {12 * HOUR} AND b.us < a.us + {12 * HOUR}),
g AS (SELECT * FROM p WHERE iou >= 0.1 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY iou DESC, rid) = 1),
c AS (SELECT user_id, label, count(*) AS n FROM g GROUP BY 1, 2), r AS (SELECT *, sum(n) OVER (PARTITION BY user_id) AS total, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, label) AS rn FROM c)
SELECT user_id, CASE WHEN n >= 2 AND n / total >= 0.7 THEN label END AS label, n AS top_votes, CAST(total AS BIGINT) AS votes FROM r WHERE rn = 1""")
def _(t: Tables):
    """Votes bridged by time and overlap, then a dominant label per user."""
    e = event_boxes(t)
    left = e.filter("event_type = 'view'").select("event_id", "user_id", "us", "x1", "y1", "x2", "y2")
    right = right_boxes(e.filter("event_type = 'click'"), "user_id", F.col("us").alias("rus"), F.col("event_id").alias("rid"), (F.col("k") % 2).alias("label"))
    b = bridge_by_time(left, right, ["user_id"], ["event_id"], "us", "rus", 12 * HOUR, 0.1, ["rid", "label"], ["rid"])
    return votes.majority(b, ["user_id"], "label", 2, 0.7)


def detections(t: Tables):
    e = event_boxes(t).withColumn("label", (F.col("user_id") % 3).cast("string")).withColumn("seq", (F.col("user_id") % 7).cast("string"))
    frame = F.concat_ws("-", "user_id", "d").alias("frame")
    cols = ["x1", "y1", "x2", "y2"]
    truth = e.filter("event_type in ('view', 'signup')").select("seq", frame, "label", F.col("event_id").alias("truth_id"), (F.col("k") % 6 == 0).alias("ignored"), *cols)
    pred = e.filter("event_type in ('click', 'error')").select("seq", frame, "label", F.col("event_id").alias("pred_id"), (F.col("cents") / 1e5).alias("score"), *cols)
    return pred, truth, e.select("seq", frame).distinct()


@query("agg19_detection_counts")
def _(t: Tables):
    """Counts per class and sequence with subtotals; literal cases are unit-tested."""
    pred, truth, manifest = detections(t)
    return reports.detection_counts(pred, truth, manifest, ["seq", "frame"], "label", 0.1, ["seq"])


@query("agg19_envelope_totals", f"""WITH {EB}, f AS (SELECT user_id, d, user_id % 3 AS label, count_if(event_type IN ('view','signup') AND k % 6 <> 0) AS truths, count_if(event_type IN ('click','error')) AS preds FROM eb GROUP BY 1, 2)
SELECT CAST(sum(truths) AS BIGINT) AS truths, CAST(sum(preds) AS BIGINT) AS preds, count(*) AS frames FROM f""")
def _(t: Tables):
    """Whatever is matched, truths and predictions must add up over all frames."""
    pred, truth, manifest = detections(t)
    d = reports.detection_counts(pred, truth, manifest, ["seq", "frame"], "label", 0.1, ["seq"]).filter("label is null and seq is null")
    return d.select((F.col("tp") + F.col("fn")).alias("truths"), (F.col("tp") + F.col("fp") + F.col("ignored")).alias("preds"), "frames")


@query("agg21_tracking_scores")
def _(t: Tables):
    """HOTA and identity scores of event boxes by user parity against their shifted copies."""
    e = event_boxes(t).select((F.col("user_id") % 10).alias("seq"), F.concat_ws("-", "user_id", "d").alias("frame"), F.col("event_id"), "event_type", "x1", "y1", "x2", "y2", "k")
    truth = e.filter("event_type in ('view', 'signup')").select("seq", "frame", (F.col("k") % 20).alias("gt"), "x1", "y1", "x2", "y2").dropDuplicates(["seq", "frame", "gt"])
    pred = e.filter("event_type in ('click', 'view')").select("seq", "frame", (F.col("k") % 15).alias("tr"), "x1", "y1", "x2", "y2").dropDuplicates(["seq", "frame", "tr"])
    return reports.tracking_scores(truth, pred, ["seq"], "frame", [0.05 * i for i in range(1, 20)])


@query("agg28_failure_census", f"""WITH {EV} SELECT event_type, CASE WHEN k < 10 THEN 'no_points' WHEN cents < 1000 THEN 'low_support' WHEN k > 90 AND cents > 5000 THEN 'outlier' ELSE 'unattributed' END AS rule, count(*) AS n FROM ev GROUP BY 1, 2""")
def _(t: Tables):
    return reports.staged_census(t.ev, ["event_type"], [("no_points", F.col("k") < 10), ("low_support", F.col("cents") < 1000), ("outlier", (F.col("k") > 90) & (F.col("cents") > 5000))])


@query("agg30_run_deltas", f"""WITH {EV}, a AS (SELECT user_id, count(*) AS n, CAST(sum(cents) AS BIGINT) AS c FROM ev WHERE event_type='click' GROUP BY 1), b AS (SELECT user_id, count(*) AS n, CAST(sum(cents) AS BIGINT) AS c FROM ev WHERE event_type='view' GROUP BY 1)
SELECT user_id, coalesce(a.n, 0) AS n_a, coalesce(b.n, 0) AS n_b, coalesce(b.n, 0) - coalesce(a.n, 0) AS n_delta, coalesce(a.c, 0) AS c_a, coalesce(b.c, 0) AS c_b, coalesce(b.c, 0) - coalesce(a.c, 0) AS c_delta FROM a FULL JOIN b USING (user_id)""")
def _(t: Tables):
    g = lambda e: t.ev.filter(F.col("event_type") == e).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("c"))
    return reports.compare_runs(g("click"), g("view"), ["user_id"], ["n", "c"])


@query("agg32_label_consistency", f"""WITH {EV}, n AS (SELECT user_id % 30 AS job, k % 10 AS label, cents % 3 AS ident, count(*) AS n FROM ev GROUP BY 1, 2, 3),
g AS (SELECT job, label, count(*) AS ids, max(n) AS top, sum(n) AS a FROM n GROUP BY 1, 2) SELECT job, count(*) AS labels, count_if(ids = 1) AS consistent, sum(top)::DOUBLE / sum(a)::DOUBLE AS top_share FROM g GROUP BY 1""")
def _(t: Tables):
    d = t.ev.select((F.col("user_id") % 30).alias("job"), (F.col("k") % 10).alias("label"), (F.col("cents") % 3).alias("ident"))
    return reports.label_consistency(d, ["job"], "label", "ident")


@query("agg32_greedy_naming", f"""WITH RECURSIVE {EV}, n AS (SELECT user_id % 30 AS job, k % 6 AS label, cents % 6 AS ident, count(*) AS n FROM ev GROUP BY 1, 2, 3), o AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY n DESC, label, ident) AS i FROM n),
f AS (SELECT job, 0::BIGINT AS i, []::BIGINT[] AS ul, []::BIGINT[] AS ui, 0::BIGINT AS hits FROM (SELECT DISTINCT job FROM o) UNION ALL
  SELECT f.job, o.i, CASE WHEN NOT list_contains(ul, label) AND NOT list_contains(ui, ident) THEN list_append(ul, label) ELSE ul END, CASE WHEN NOT list_contains(ul, label) AND NOT list_contains(ui, ident) THEN list_append(ui, ident) ELSE ui END,
    CASE WHEN NOT list_contains(ul, label) AND NOT list_contains(ui, ident) THEN hits + n ELSE hits END FROM f JOIN o ON o.job = f.job AND o.i = f.i + 1)
SELECT job, (SELECT count(*) FROM ev WHERE user_id % 30 = f.job) AS rows, max(hits) AS hits, len(arg_max(ul, i)) AS named, max(hits) / (SELECT count(*) FROM ev WHERE user_id % 30 = f.job) AS accuracy FROM f GROUP BY job""")
def _(t: Tables):
    d = t.ev.select((F.col("user_id") % 30).alias("job"), (F.col("k") % 6).alias("label"), (F.col("cents") % 6).alias("ident"))
    return reports.greedy_naming(d, ["job"], "label", "ident")


@query("agg34_colour_collisions", f"""WITH {EV}, p AS (SELECT user_id, us // {DAY} AS d, k % 8 AS c, count(*) AS n FROM ev GROUP BY 1, 2, 3) SELECT user_id, d, CAST(sum(n) AS BIGINT) AS boxes, CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS colliding FROM p GROUP BY 1, 2""")
def _(t: Tables):
    d = t.ev.withColumn("d", F.floor(F.col("us") / F.lit(DAY)))
    return reports.colour_collisions(d, ["user_id", "d"], "k", 8)


@query("agg34_id_flips", f"""WITH {EV}, p AS (SELECT user_id, k % 4 AS i, lag(k % 4) OVER (PARTITION BY user_id ORDER BY us) AS pi FROM ev) SELECT user_id, count(*) AS rows, count_if(pi <> i) AS flips, count(DISTINCT i) AS ids FROM p GROUP BY 1""")
def _(t: Tables):
    return reports.id_flips(t.ev.select("user_id", "us", (F.col("k") % 4).alias("i")), ["user_id"], ["us"], "i")


@query("agg36_outage_verdicts", f"""WITH {EV}, a AS (SELECT event_id, user_id, us FROM ev WHERE event_type='purchase'),
n AS (SELECT a.event_id, count(*) FILTER (e.event_type='view') AS ball, count(*) FILTER (e.event_type='click') AS players FROM a LEFT JOIN ev e ON e.user_id=a.user_id AND abs(e.us - a.us) <= {18 * HOUR} AND e.event_type IN ('view','click') GROUP BY 1)
SELECT event_id, ball, players, CASE WHEN ball = 0 AND players = 0 THEN 'outage' WHEN ball = 0 OR players = 0 THEN 'partial' ELSE 'live' END AS verdict FROM n""")
def _(t: Tables):
    a = t.ev.filter("event_type = 'purchase'").select("event_id", "user_id", "us")
    rows = {n: t.ev.filter(F.col("event_type") == e).select("user_id", F.col("us").alias("rus")) for n, e in (("ball", "view"), ("players", "click"))}
    return reports.outage_verdicts(a, rows, ["user_id"], "event_id", "us", "rus", 18 * HOUR).select("event_id", "ball", "players", "verdict")


@query("agg37_source_mix", f"""WITH {EV}, m AS (SELECT user_id, us, k < 30 AS f, CASE WHEN (k < 30) = lag(k < 30) OVER (PARTITION BY user_id ORDER BY us) THEN 0 ELSE 1 END AS o FROM ev), r AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY us) AS r FROM m),
g AS (SELECT user_id, r, bool_or(f) AS f, count(*) AS n FROM r GROUP BY 1, 2) SELECT user_id, CAST(sum(n) AS BIGINT) AS rows, CAST(sum(CASE WHEN f THEN n ELSE 0 END) AS BIGINT) AS filled_rows, coalesce(max(CASE WHEN f THEN n END), 0) AS longest_filled FROM g GROUP BY 1""")
def _(t: Tables):
    d = t.ev.select("user_id", "us", F.when(F.col("k") < 30, "interp").otherwise("det").alias("source"))
    return reports.source_mix(d, ["user_id"], ["us"], "source", "interp")


@query("agg38_keypoint_rates", """WITH d AS (SELECT label, unnest(range(0, 8)) AS kp, embedding FROM embeddings)
SELECT label, kp::INTEGER AS keypoint, count(*) AS n, count_if(embedding[kp * 2 + 1] BETWEEN -0.1::FLOAT AND 0.1::FLOAT AND embedding[kp * 2 + 2] > 0) / count(*) AS inside_share FROM d GROUP BY 1, 2""")
def _(t: Tables):
    """Vector components in pairs as keypoints."""
    pts = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.struct(F.get("embedding", i * 2).alias("x"), F.get("embedding", i * 2 + 1).alias("y"), F.lit(1.0).alias("c")))
    inside = F.col("kp.x").between(F.lit(-0.1).cast("float"), F.lit(0.1).cast("float")) & (F.col("kp.y") > 0)
    return reports.keypoint_rates(t.embeddings.select("label", pts.alias("pts")), ["label"], "pts", inside).drop("mean_conf")


@query("agg40_accuracy_at", f"""WITH {EV}, d AS (SELECT event_type, k, cents % 100 < k AS ok, unnest([0.3::DOUBLE, 0.5::DOUBLE, 0.7::DOUBLE]) AS threshold FROM ev)
SELECT event_type, threshold, count_if(k / 100.0::DOUBLE >= threshold) / count(*) AS coverage, count_if(k / 100.0::DOUBLE >= threshold AND ok) / count_if(k / 100.0::DOUBLE >= threshold) AS accuracy FROM d GROUP BY 1, 2""")
def _(t: Tables):
    d = t.ev.withColumn("conf", F.col("k") / 100.0)
    return reports.accuracy_at(d, ["event_type"], "conf", F.col("cents") % 100 < F.col("k"), [0.3, 0.5, 0.7])


@query("agg40_recovery_latency", f"""WITH {EV} SELECT e.event_id, e.user_id, least(coalesce(c.us - e.us, {2 * DAY}), {2 * DAY}) AS latency FROM (SELECT * FROM ev WHERE event_type='error') e ASOF LEFT JOIN (SELECT * FROM ev WHERE event_type='click') c ON c.user_id = e.user_id AND e.us <= c.us""")
def _(t: Tables):
    s, h = t.ev.filter("event_type = 'error'").select("event_id", "user_id", "us"), t.ev.filter("event_type = 'click'").select("user_id", F.col("us").alias("hus"))
    return reports.recovery_latency(s, h, ["user_id"], "event_id", "us", "hus", 2 * DAY)


@query("agg46_tracker_diagnostics", f"""WITH {EV}, n AS (SELECT user_id % 20 AS seq, k AS track, count(*) AS len FROM ev GROUP BY 1, 2) SELECT seq, count(*) AS tracklets, count_if(len = 1) AS singletons, median(len)::DOUBLE AS median_length FROM n GROUP BY 1""")
def _(t: Tables):
    return reports.tracker_diagnostics(t.ev.withColumn("seq", F.col("user_id") % 20), ["seq"], "k")


@query("agg50_retrieval_scores", f"""WITH {EV}, r AS (SELECT user_id, us, CASE WHEN k % 4 <> 0 THEN k % 7 END AS rd, user_id % 7 AS tr FROM ev), f AS (SELECT user_id, rd = tr AS ok FROM r WHERE rd IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY us DESC) = 1),
g AS (SELECT user_id, bool_or(coalesce(rd = tr, false)) AS a FROM r GROUP BY 1) SELECT count(*) AS queries, count_if(a) AS found, count_if(coalesce(ok, false)) AS top1, count(ok) AS attempted FROM g LEFT JOIN f USING (user_id)""")
def _(t: Tables):
    d = t.ev.select("user_id", "us", F.when(F.col("k") % 4 != 0, F.col("k") % 7).alias("rd"), (F.col("user_id") % 7).alias("tr"))
    return reports.retrieval_scores(d, ["user_id"], [F.col("us").desc()], "rd", "tr")


@query("win37_label_consensus", f"""WITH {EV}, d AS (SELECT event_id, user_id, us, us // {DAY} AS d, CASE WHEN k > 80 THEN k % 2 ELSE 0 END AS label FROM ev), f AS (SELECT *, row_number() OVER (PARTITION BY user_id, d ORDER BY us) = 1 AS nw FROM d)
SELECT event_id, CAST(sum(nw::INT) OVER w AS BIGINT) AS frames, CASE WHEN min(label) OVER w <> max(label) OVER w THEN 'conflict' WHEN sum(nw::INT) OVER w >= 2 THEN 'supported' ELSE 'provisional' END AS status FROM f WINDOW w AS (PARTITION BY user_id ORDER BY us)""")
def _(t: Tables):
    d = t.ev.select("event_id", "user_id", "us", F.floor(F.col("us") / F.lit(DAY)).alias("d"), F.when(F.col("k") > 80, F.col("k") % 2).otherwise(0).alias("label"))
    return reports.label_consensus(d, ["user_id"], ["us"], "d", "label").select("event_id", "frames", "status")


@query("win45_quadratic_fit")
def _(t: Tables):
    """Weighted parabola of quantity over line number per supplier with inlier rounds (unit-tested fit)."""
    d = t.lineitem.select("l_suppkey", F.col("l_linenumber").cast("double").alias("t"), F.col("l_quantity").alias("y"), (F.lit(1.0) - F.col("l_discount")).alias("w"))
    return reports.quadratic_flight(d, ["l_suppkey"], "t", "y", "w", 3, 15.0, 6)


@query("win45_best_flight")
def _(t: Tables):
    """Best quadratic flight of each user's points (hours as seconds) into the origin; fitted against numpy in the tests."""
    d = t.ev.select("user_id", (F.col("us") / F.lit(HOUR) - 470_000).alias("t"), (F.col("k") / 10.0 - 5).alias("x"), (F.col("cents") % 50 / 10.0 - 2).alias("y"), ((F.col("cents") % 97 + 1) / 97.0).alias("score"))
    return reports.best_flights(d, ["user_id"], F.hypot("x", "y") <= 3, gate=5.0, min_inliers=6, span_min=1.0, lookback=400.0, end_max=5.0)


@query("udf01_cached_verdicts", """WITH m AS (SELECT conv_id, count(*) AS turns, count_if(role = 'assistant') AS a FROM conversations GROUP BY 1)
SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 'cached' ELSE 'toy' END AS backend, CASE WHEN a * 2 >= turns THEN 'made_fg' ELSE 'unclear' END AS outcome FROM m""")
def _(t: Tables):
    """A toy judge runs on cache misses only; cached keys keep their stored verdict."""
    m = t.conversations.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.count_if(F.col("role") == "assistant").alias("a"))
    m = m.withColumn("key", stage.content_key(F.col("conv_id"), F.col("turns"), F.col("a")))
    made = F.when(F.col("a") * 2 >= F.col("turns"), "made_fg").otherwise("unclear")
    cache = m.filter("conv_id % 3 = 0").select("key", made.alias("outcome"), F.lit("cached").alias("backend"))

    def judge(pdf):
        out = pdf[["conv_id", "key"]].copy()
        out["outcome"] = ["made_fg" if a * 2 >= n else "unclear" for a, n in zip(pdf["a"], pdf["turns"])]
        out["backend"] = "toy"
        return out[["conv_id", "key", "outcome", "backend"]]

    fresh = reports.verdicts(stage.cache_misses(m, cache, "key"), "conv_id", judge, "key string, outcome string, backend string")
    hits = m.select("conv_id", "key").join(cache, "key").select("conv_id", "key", "outcome", "backend")
    return fresh.unionByName(hits).select("conv_id", "backend", "outcome")


@query("udf02_specialist", f"WITH {EV} SELECT user_id, count(*) AS n FROM ev WHERE event_type = 'view' GROUP BY 1")
def _(t: Tables):
    schema = T.StructType.fromDDL("user_id bigint, n bigint")
    return reports.run_specialist(lambda x: x["views"].groupBy("user_id").agg(F.count(F.lit(1)).alias("n")), {"views": t.ev.filter("event_type = 'view'")}, ["views"], schema)


@query("udf03_resumable_sweep", f"WITH {EV}, v AS (SELECT unnest(['a', 'b']) AS variant) SELECT event_id, variant, k * CASE variant WHEN 'a' THEN 2 ELSE 3 END AS fit FROM ev, v WHERE NOT (variant = 'a' AND event_id % 2 = 0)")
def _(t: Tables):
    rows = t.ev.select("event_id", "k")
    done = rows.filter("event_id % 2 = 0").select("event_id", F.lit("a").alias("variant"))

    def fit(pdf):
        out = pdf[["event_id", "variant"]].copy()
        out["fit"] = pdf["k"] * pdf["variant"].map({"a": 2, "b": 3})
        return out

    return reports.sweep(rows, ["a", "b"], done, ["event_id"], fit, "event_id bigint, variant string, fit bigint")


@query("udf04_expand_span", f"WITH {EV} SELECT event_id, unnest(range(us, us + k * {HOUR}, {6 * HOUR})) AS t FROM ev WHERE k > 0")
def _(t: Tables):
    """Row expansion with the built-in form."""
    d = t.ev.filter("k > 0")
    return d.select("event_id", F.explode(F.sequence(F.col("us"), F.col("us") + F.col("k") * HOUR - 1, F.lit(6 * HOUR))).alias("t"))


@query("ord05_rank_candidates", f"""WITH {EV}, c AS (SELECT event_id, user_id, CASE event_type WHEN 'view' THEN true WHEN 'error' THEN false END AS m, CASE WHEN k % 3 = 0 THEN k::DOUBLE END AS l, (cents % 90)::DOUBLE AS p, CASE WHEN k % 2 = 0 THEN k / 100.0::DOUBLE END AS rc FROM ev)
SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN m = false THEN 1 ELSE 0 END, CASE WHEN l IS NULL THEN 1 ELSE 0 END, coalesce(l, p), -coalesce(rc, 0.0::DOUBLE), event_id) AS "rank" FROM c QUALIFY "rank" <= 5""")
def _(t: Tables):
    k = F.col("k")
    d = t.ev.select("event_id", "user_id", F.when(F.col("event_type") == "view", True).when(F.col("event_type") == "error", False).alias("m"), F.when(k % 3 == 0, k.cast("double")).alias("l"),
                    (F.col("cents") % 90).cast("double").alias("p"), F.when(k % 2 == 0, k / 100.0).alias("rc"))
    return reports.rank_candidates(d, ["user_id"], 5, "m", "l", "p", "rc", "event_id").select("event_id", "user_id", "rank")


PLAYS = f"""{EV}, b AS (SELECT min(us) AS lo FROM ev), pl AS (SELECT user_id, event_id, CASE WHEN event_type = 'signup' THEN 'Free Throw' ELSE 'Jump Shot' END AS ty, event_type <> 'view' AS sh, k % 2 = 0 AS sc, 1 + cents % 3 AS sv, (us - lo) / 1000000.0::DOUBLE AS vt, CASE WHEN event_type='error' THEN 'assist' ELSE 'x' END AS tx FROM ev, b)"""


def plays(t: Tables):
    base = t.ev.agg(F.min("us").alias("lo"))
    return t.ev.join(F.broadcast(base), F.lit(True)).select(  # one-row bound
        F.col("user_id").alias("game_key"), F.col("event_id").alias("play_id"), F.when(F.col("event_type") == "signup", "Free Throw").otherwise("Jump Shot").alias("type_text"),
        (F.col("event_type") != "view").alias("shooting_play"), (F.col("k") % 2 == 0).alias("scoring_play"), (F.lit(1) + F.col("cents") % 3).alias("score_value"), ((F.col("us") - F.col("lo")) / 1e6).alias("video_t"),
        F.col("k").cast("string").alias("shooter_jersey"), F.when(F.col("event_type") == "error", "assist").otherwise("x").alias("text"))


@query("win44_truth_shots", f"""WITH {PLAYS} SELECT event_id AS play_id, ty = 'Free Throw' AS free_throw, CASE WHEN ty <> 'Free Throw' THEN CAST(round_even((vt - 86400.0::DOUBLE) * 1000, 0) AS BIGINT) END AS ts_ms, sc AS made, CASE WHEN sc THEN sv ELSE 0 END AS points
FROM pl WHERE sh AND vt >= 86400 AND vt < 1728000""")
def _(t: Tables):
    """Truth of the second to twentieth day on the segment's own clock."""
    return hoops.truth_shots(plays(t), 86400.0, 1728000.0).select("play_id", "free_throw", "ts_ms", "made", "points")


@query("win44_truth_box", f"""WITH {PLAYS} SELECT user_id AS game_key, count_if(sh AND ty <> 'Free Throw') AS fga, count_if(sh AND ty <> 'Free Throw' AND sc) AS fgm, count_if(sh AND ty = 'Free Throw') AS fta, count_if(sh AND ty = 'Free Throw' AND sc) AS ftm, count_if(tx = 'assist') AS ast FROM pl GROUP BY 1""")
def _(t: Tables):
    return hoops.truth_box(plays(t))


@query("ord02_event_order", f"WITH {EV} SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY us // {DAY}, event_type, event_id) - 1 AS position FROM ev")
def _(t: Tables):
    """Events of a user by day, then type."""
    d = t.ev.select("user_id", "event_id", "event_type", F.floor(F.col("us") / F.lit(DAY)).alias("d"))
    d = scan(d, ["user_id"], ["d", "event_type", "event_id"], {"position": row_number()})
    return d.select("user_id", "event_id", (F.col("position") - 1).alias("position"))
