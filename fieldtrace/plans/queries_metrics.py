"""Calibration, ranking, classification and displacement metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtrace.operators import metrics, uncertainty
from fieldtrace.plans.registry import DAY, EV, Tables, query

SCORED = f"""{EV}, s AS (SELECT event_id, user_id % 5 AS grp, (k::DOUBLE / 100.0::DOUBLE) AS p, (cents * 7 + k * 13) % 100 < k AS y, event_type FROM ev)"""


def scored(t: Tables):
    return t.ev.select("event_id", (F.col("user_id") % 5).alias("grp"), (F.col("k") / 100.0).alias("p"),
                       ((F.col("cents") * 7 + F.col("k") * 13) % 100 < F.col("k")).alias("y"), "event_type")


@query("agg16_reliability_bins", f"""WITH {SCORED}, b AS (SELECT *, least(floor(p * 10)::INTEGER, 9) AS bin FROM s)
SELECT grp, bin, count(*) AS n, sum(p::DECIMAL(28,9))::DOUBLE / count(p) AS mean_score, count_if(y) / count(*) AS accuracy FROM b GROUP BY 1, 2""")
def _(t: Tables):
    return metrics.reliability_bins(scored(t), ["grp"], "p", F.col("y"))


@query("agg16_calibration", f"""WITH {SCORED}, b AS (SELECT *, least(floor(p * 10)::INTEGER, 9) AS bin FROM s),
g AS (SELECT grp, bin, count(*) AS n, sum(p::DECIMAL(28,9)) AS sp, count_if(y) AS sy, sum(((p - y::INTEGER) * (p - y::INTEGER))::DECIMAL(28,9)) AS sb FROM b GROUP BY 1, 2)
SELECT grp, CAST(sum(n) AS BIGINT) AS n, sum(abs(sp - sy))::DOUBLE / sum(n)::DOUBLE AS ece, sum(sb)::DOUBLE / sum(n)::DOUBLE AS brier FROM g GROUP BY 1""")
def _(t: Tables):
    return metrics.calibration_summary(scored(t), ["grp"], "p", F.col("y"))


@query("agg16_precision_at_coverage", f"""WITH {SCORED}, c AS (SELECT grp, p, count(*) AS n, count_if(y) AS pos FROM s GROUP BY 1, 2),
u AS (SELECT *, sum(n) OVER w AS cn, sum(pos) OVER w AS cp, sum(n) OVER (PARTITION BY grp) AS tn FROM c WINDOW w AS (PARTITION BY grp ORDER BY p DESC))
SELECT grp, p AS threshold, CAST(cn AS BIGINT) AS answered, cn::DOUBLE / tn::DOUBLE AS coverage, cp::DOUBLE / cn::DOUBLE AS "precision" FROM u""")
def _(t: Tables):
    return metrics.precision_at_coverage(scored(t), ["grp"], "p", F.col("y"))


@query("agg17_isotonic", f"""WITH {SCORED}, c AS (SELECT p, count(*) AS n, count_if(y) AS pos FROM s GROUP BY 1),
w AS (SELECT a.p, max(mn) AS value FROM (SELECT i.p AS p, j.p AS lo, min(cum) AS mn FROM c i JOIN c j ON j.p <= i.p
  JOIN LATERAL (SELECT sum(x.pos)::DOUBLE / sum(x.n)::DOUBLE AS cum FROM c h JOIN c x ON x.p BETWEEN j.p AND h.p WHERE h.p >= i.p GROUP BY h.p) z ON true GROUP BY i.p, j.p) a GROUP BY a.p)
SELECT round(max(p) * 100)::BIGINT AS score_to, round(value * 1e9)::BIGINT AS value FROM w GROUP BY w.value""")
def _(t: Tables):
    """Isotonic steps against the max-min formula (values compared at nine decimals)."""
    d = scored(t).withColumn("yi", F.col("y").cast("int"))
    s = metrics.isotonic(d, [], "p", "yi")
    return s.select(F.round(F.col("score_to") * 100).cast("long").alias("score_to"), F.round(F.col("value") * 1e9).cast("long").alias("value"))


@query("agg18_abstention", f"""WITH {EV}, s AS (SELECT user_id % 5 AS grp, CASE WHEN cents % 3 = 0 THEN 'unclear' ELSE event_type END AS answer, CASE WHEN k % 4 = 0 THEN 'click' ELSE event_type END AS truth, 'click' AS rule FROM ev)
SELECT grp, count(*) AS n, count_if(answer <> 'unclear') / count(*) AS coverage, count_if(answer <> 'unclear' AND answer = truth) / count_if(answer <> 'unclear') AS accuracy_answered,
  count_if(answer <> 'unclear' AND rule = truth) / count_if(answer <> 'unclear') AS rule_answered, count_if(answer = 'unclear' AND rule = truth) / count_if(answer = 'unclear') AS rule_abstained,
  count_if(answer = truth) / count(*) AS forced_accuracy FROM s GROUP BY 1""")
def _(t: Tables):
    e = F.col("event_type")
    d = t.ev.select((F.col("user_id") % 5).alias("grp"), F.when(F.col("cents") % 3 == 0, "unclear").otherwise(e).alias("answer"),
                    F.when(F.col("k") % 4 == 0, "click").otherwise(e).alias("truth"), F.lit("click").alias("rule"), F.lit(1.0).alias("conf"))
    return metrics.abstention_report(d, ["grp"], "answer", "truth", "rule", "conf")


@query("agg22_ranking", f"""WITH {EV}, r AS (SELECT user_id, k, row_number() OVER (PARTITION BY user_id ORDER BY cents DESC, event_id) AS r, event_id,
  row_number() OVER (PARTITION BY user_id ORDER BY k DESC, event_id) AS c FROM ev)
SELECT count(*) AS n, count_if(r = 1) / count(*) AS top1, count_if(r <= 3) / count(*) AS top3, sum((1.0::DOUBLE / r)::DECIMAL(28,9))::DOUBLE / count(*) AS mrr FROM r WHERE c = 1""")
def _(t: Tables):
    """Options are a user's events scored by value; the chosen one has the user's largest k."""
    best = t.ev.groupBy("user_id").agg(F.min_by("event_id", F.struct(-F.col("k"), "event_id")).alias("chosen"))
    d = t.ev.join(best, "user_id")
    return metrics.ranking_metrics(d, ["user_id"], "cents", ["event_id"], F.col("event_id") == F.col("chosen"))


@query("agg23_probability_metrics", f"""WITH {SCORED}, c AS (SELECT grp, p, count(*) AS n, count_if(y) AS pos FROM s GROUP BY 1, 2),
u AS (SELECT *, sum(n) OVER w AS cn, sum(pos) OVER w AS cp FROM c WINDOW w AS (PARTITION BY grp ORDER BY p DESC)),
a AS (SELECT grp, CAST(sum(pos * (2 * (cn - cp) - (n - pos))) AS BIGINT) AS u2, sum((pos * cp::DOUBLE / cn::DOUBLE)::DECIMAL(28,9))::DOUBLE AS ap FROM u GROUP BY 1),
b AS (SELECT grp, count(*) AS n, count_if(y) AS positives, sum(((p - y::INTEGER) * (p - y::INTEGER))::DECIMAL(28,9))::DOUBLE / count(*) AS brier FROM s GROUP BY 1)
SELECT grp, n, positives, brier, 1.0 - u2::DOUBLE / (2.0::DOUBLE * positives * (n - positives)) AS auc, ap / positives AS average_precision,
  positives / n AS prevalence, 1.0 - brier / (positives / n * (1.0 - positives / n)) AS skill FROM a JOIN b USING (grp)""")
def _(t: Tables):
    return metrics.probability_metrics(scored(t), ["grp"], "p", F.col("y")).drop("log_loss")


@query("agg23_label_quality", """WITH s AS (SELECT least(n_chars::DOUBLE / 20000.0::DOUBLE, 1.0::DOUBLE) AS p, quality = 1 AS y FROM documents JOIN labels USING (doc_id))
SELECT count(*) AS n, count_if(y) AS positives, sum(((p - y::INTEGER) * (p - y::INTEGER))::DECIMAL(28,9))::DOUBLE / count(*) AS brier FROM s""")
def _(t: Tables):
    d = t.documents.select("doc_id", F.least(F.col("n_chars") / 20000.0, F.lit(1.0)).alias("p")).join(t.labels, "doc_id")
    return metrics.probability_metrics(d, [], "p", F.col("quality") == 1).select("n", "positives", "brier")


@query("agg24_bootstrap")
def _(t: Tables):
    """Cluster bootstrap interval of a mean difference (hash weights: no SQL twin)."""
    d = scored(t).withColumn("user", F.col("event_id") % 150)
    y = F.col("y").cast("double")
    return metrics.bootstrap_mean_difference(d, ["user"], (F.col("p") - y) * (F.col("p") - y) - (F.lit(0.5) - y) * (F.lit(0.5) - y), 500, 11)


@query("agg25_higher_quantile", f"""WITH {EV}, r AS (SELECT user_id % 10 AS grp, cents, row_number() OVER (PARTITION BY user_id % 10 ORDER BY cents) - 1 AS i, count(*) OVER (PARTITION BY user_id % 10) AS n FROM ev)
SELECT grp, n, max(CASE WHEN i = CAST(ceil(0.9::DOUBLE * (n - 1)) AS BIGINT) THEN cents END) AS conformal, max(CASE WHEN i = CAST(ceil(0.95::DOUBLE * n) AS BIGINT) - 1 THEN cents END) AS p95 FROM r GROUP BY 1, 2""")
def _(t: Tables):
    d = t.ev.withColumn("grp", F.col("user_id") % 10)
    return metrics.quantiles(d, ["grp"], "cents", {"conformal": (0.9, "higher"), "p95": (0.95, "nearest_rank")})


@query("agg25_displacement", f"""WITH {EV}, e AS (SELECT user_id % 10 AS grp, user_id, us, abs(k - 50)::DOUBLE AS err FROM ev),
w AS (SELECT grp, user_id, sum(err::DECIMAL(28,9)) AS s, count(*) AS n, arg_max(err, us) AS f FROM e GROUP BY 1, 2)
SELECT grp, count(*) AS windows, sum(s)::DOUBLE / sum(n)::DOUBLE AS ade, sum(f::DECIMAL(28,9))::DOUBLE / count(*) AS fde FROM w GROUP BY 1""")
def _(t: Tables):
    d = t.ev.withColumn("grp", F.col("user_id") % 10)
    return metrics.displacement(d, ["grp"], ["user_id"], "us", F.abs(F.col("k") - 50).cast("double"))


FORECAST = f"""{EV}, w AS (SELECT user_id % 10 AS grp, user_id, us // {7 * DAY} AS win, us, event_id, user_id % 3 = 0 AS cal, k::DOUBLE AS tx, (cents % 60)::DOUBLE AS ty, (k + cents % 7 - 3)::DOUBLE AS mx, (cents % 60 + k % 5 - 2)::DOUBLE AS my, 1 + (k % 4)::DOUBLE AS scale FROM ev),
e AS (SELECT *, sqrt((tx - mx) * (tx - mx) + (ty - my) * (ty - my)) AS miss FROM w)"""


def forecasts(t: Tables):
    k, c = F.col("k"), F.col("cents")
    d = t.ev.select((F.col("user_id") % 10).alias("grp"), "user_id", F.floor(F.col("us") / F.lit(7 * DAY)).alias("win"), "us", k.cast("double").alias("tx"), (c % 60).cast("double").alias("ty"), (k + c % 7 - 3).cast("double").alias("mx"),
                    (c % 60 + k % 5 - 2).cast("double").alias("my"), (1 + k % 4).cast("double").alias("scale"))
    return d.filter("user_id % 3 = 0"), d.filter("user_id % 3 <> 0")


@query("agg25_gaussian_coverage", f"""WITH {FORECAST}, r AS (SELECT grp, miss / scale AS z, row_number() OVER (PARTITION BY grp ORDER BY miss / scale) - 1 AS i, count(*) OVER (PARTITION BY grp) AS n FROM e WHERE cal),
q AS (SELECT grp, max(z) FILTER (WHERE i = ceil(0.9::DOUBLE * (n - 1))) AS factor FROM r GROUP BY 1),
t AS (SELECT e.*, factor, miss * miss / (2 * scale * scale) + 2 * ln(scale) + ln(2 * pi()) AS l, miss <= scale * sqrt(-2 * ln(1 - 0.9::DOUBLE)) AS own, miss <= factor * scale AS inside, factor * scale AS radius FROM e JOIN q USING (grp) WHERE NOT cal),
p AS (SELECT grp, user_id, win, count(*) AS n, sum(l) AS l, count_if(own) AS own, count_if(inside) AS ins, arg_max(inside, us)::INT AS ei, arg_max(radius, us) AS er, any_value(factor) AS factor FROM t GROUP BY ALL)
SELECT grp, count(*) AS windows, sum(n)::BIGINT AS points, max(factor) AS factor, round(sum(l) / sum(n), 9) AS mean_nll, sum(own) / sum(n) AS own_coverage, sum(ins) / sum(n) AS coverage, avg(ei) AS end_coverage, round(avg(er), 9) AS mean_end_radius FROM p GROUP BY 1""")
def _(t: Tables):
    """A third of the users calibrates the radius, the others are covered by it or not."""
    calibration, test = forecasts(t)
    return uncertainty.gaussian_report(calibration, test, ["grp"], ["user_id", "win"], "us")


@query("agg25_age_radii", f"""WITH {EV}, a AS (SELECT user_id % 10 AS grp, user_id % 3 = 0 AS cal, event_id, (cents % 400) / 100.0::DOUBLE AS age, (k * (1 + cents % 5))::DOUBLE AS err, event_type <> 'error' AS est FROM ev),
b AS (SELECT grp, err, b, row_number() OVER (PARTITION BY grp, b ORDER BY err) - 1 AS i, count(*) OVER (PARTITION BY grp, b) AS n FROM a, range(1, 4) u(b) WHERE cal AND age > b - 1 AND age <= b + 1e-6),
q AS (SELECT grp, b, max(err) FILTER (WHERE i = ceil(0.9::DOUBLE * (n - 1))) AS radius FROM b GROUP BY ALL)
SELECT event_id, CASE WHEN est THEN radius END AS radius, CASE WHEN est THEN err <= radius END AS covered FROM a LEFT JOIN q ON q.grp = a.grp AND q.b = least(greatest(ceil(age - 1e-6), 1), 3) WHERE NOT cal""")
def _(t: Tables):
    d = t.ev.select((F.col("user_id") % 10).alias("grp"), "user_id", "event_id", (F.col("cents") % 400 / F.lit(100.0)).alias("age"), (F.col("k") * (1 + F.col("cents") % 5)).cast("double").alias("err"), "event_type")
    radii = uncertainty.age_radii(d.filter("user_id % 3 = 0"), ["grp"], "age", "err")
    out = uncertainty.with_radii(d.filter("user_id % 3 <> 0"), radii, ["grp"], "age", estimated=F.col("event_type") != "error")
    return out.select("event_id", "radius", (F.col("err") <= F.col("radius")).alias("covered"))


@query("agg26_multiclass", f"""WITH {EV}, s AS (SELECT event_type AS tr, CASE WHEN k % 3 = 0 THEN 'click' ELSE event_type END AS pr FROM ev),
c AS (SELECT tr AS c FROM s UNION SELECT pr FROM s),
m AS (SELECT c.c, (SELECT count(*) FROM s WHERE tr = c.c) AS t, (SELECT count(*) FROM s WHERE pr = c.c) AS p, (SELECT count(*) FROM s WHERE tr = c.c AND pr = c.c) AS tp FROM c)
SELECT CAST(sum(t) AS BIGINT) AS n, sum(tp)::DOUBLE / sum(t)::DOUBLE AS accuracy, sum((2.0::DOUBLE * tp / (t + p))::DECIMAL(28,9))::DOUBLE / count(*) AS macro_f1, max(t)::DOUBLE / sum(t)::DOUBLE AS majority FROM m""")
def _(t: Tables):
    e = F.col("event_type")
    return metrics.multiclass_report(t.ev.select(e.alias("tr"), F.when(F.col("k") % 3 == 0, "click").otherwise(e).alias("pr")), "tr", "pr")


@query("agg26_confusion", f"""WITH {EV} SELECT user_id % 5 AS grp, event_type AS tr, CASE WHEN k % 3 = 0 THEN 'click' ELSE event_type END AS pr, count(*) AS n FROM ev GROUP BY ALL""")
def _(t: Tables):
    e = F.col("event_type")
    d = t.ev.select((F.col("user_id") % 5).alias("grp"), e.alias("tr"), F.when(F.col("k") % 3 == 0, "click").otherwise(e).alias("pr"))
    return metrics.confusion(d, ["grp"], "tr", "pr")


@query("agg27_error_report", f"""WITH {EV}, e AS (SELECT user_id % 10 AS seq, CASE WHEN event_type <> 'error' THEN cents END AS err, event_type FROM ev),
q AS (SELECT seq, count(*) AS targets, count(err) AS accepted, count_if(err <= 2000) / count(*) AS within, quantile_cont(err, 0.5) AS median, grouping(seq) AS overall FROM e GROUP BY ROLLUP (seq))
SELECT coalesce(CAST(seq AS VARCHAR), 'all') AS seq, targets, accepted, within, median::DOUBLE AS median FROM q""")
def _(t: Tables):
    """Median error of accepted targets and the share within 20.00 of all targets, overall and by sequence."""
    from fieldtrace.operators.detection import error_report
    d = t.ev.select((F.col("user_id") % 10).cast("string").alias("seq"), F.when(F.col("event_type") != "error", F.col("cents")).alias("err"))
    return error_report(d, "seq", "err", 2000)


@query("agg29_robust_prior", """WITH d AS (SELECT l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS c FROM lineitem),
m AS (SELECT l_suppkey, count(*) AS n, quantile_cont(c, 0.5)::DOUBLE AS median FROM d GROUP BY 1)
SELECT m.l_suppkey, m.n, m.median, (SELECT quantile_cont(abs(d.c - m.median), 0.5) FROM d WHERE d.l_suppkey = m.l_suppkey) AS mad FROM m""")
def _(t: Tables):
    d = t.lineitem.select("l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long").alias("c"))
    return metrics.robust_prior(d, ["l_suppkey"], "c")


@query("agg35_speed_percentiles", f"""WITH {EV}, d AS (SELECT user_id, k - lag(k) OVER w AS dk, us - lag(us) OVER w AS dt FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us)),
s AS (SELECT user_id % 10 AS grp, abs(dk) * 3600000000 // dt AS speed FROM d WHERE dt > 0)
SELECT grp, count(*) AS n, quantile_cont(speed, 0.5)::DOUBLE AS p50, quantile_cont(speed, 0.95)::DOUBLE AS p95 FROM s GROUP BY 1""")
def _(t: Tables):
    from fieldtrace.operators.ordered import prev, scan
    d = scan(t.ev, ["user_id"], ["us"], {"_p": prev(F.struct("k", "us"))}).filter("_p is not null")
    d = d.select((F.col("user_id") % 10).alias("grp"), F.expr("(abs(k - _p.k) * 3600000000) div (us - _p.us)").alias("speed"))
    return metrics.quantiles(d, ["grp"], "speed", {"p50": (0.5, "linear"), "p95": (0.95, "linear")})


@query("agg20_average_precision", f"""WITH {SCORED}, c AS (SELECT grp, p, count(*) AS n, count_if(y) AS pos FROM s GROUP BY 1, 2),
u AS (SELECT grp, sum(n) OVER w AS cn, sum(pos) OVER w AS cp, sum(pos) OVER (PARTITION BY grp) AS tr FROM c WINDOW w AS (PARTITION BY grp ORDER BY p DESC)),
pts AS (SELECT grp, i, (SELECT max(cp::DOUBLE / cn::DOUBLE) FROM u WHERE u.grp = g.grp AND cp * 100 >= i * tr) AS pr FROM (SELECT DISTINCT grp FROM s) g, range(101) r(i))
SELECT grp, sum(coalesce(pr, 0)::DECIMAL(28,9))::DOUBLE / 101.0::DOUBLE AS ap FROM pts GROUP BY 1""")
def _(t: Tables):
    d = scored(t)
    total = d.groupBy("grp").agg(F.count_if(F.col("y")).alias("truth"))
    c = metrics.score_curve(d, ["grp"], "p", F.col("y"))
    return metrics.average_precision(c, ["grp"], "p", total)
