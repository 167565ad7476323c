"""Votes, pools and identity decisions per user."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtrace.operators import tracks, votes
from fieldtrace.plans.registry import EV, HOUR, Tables, query


@query("agg01_tracklets", f"""WITH {EV} SELECT user_id, event_type, min(event_id) AS frame_start, max(event_id) AS frame_end, min(us) AS ts_start, max(us) AS ts_end,
 count(*) AS n_detections, sum(cents)::DOUBLE / count(cents) AS mean_conf FROM ev GROUP BY 1, 2""")
def _(t: Tables):
    return tracks.tracklet_summary(t.ev, ["user_id", "event_type"], "event_id", "us", "cents")


@query("agg02_presence", f"""WITH {EV}, g AS (SELECT user_id, count(*) AS n, count_if(event_type <> 'error') AS n_localized, count_if(event_type <> 'error' AND k < 60) AS n_inside FROM ev GROUP BY 1)
SELECT *, n_inside / n_localized AS ratio, n >= 60 AND n_inside / n_localized >= 0.6 AS eligible FROM g WHERE n_localized > 0""")
def _(t: Tables):
    return votes.presence_evidence(t.ev, ["user_id"], F.col("event_type") != "error", F.col("k") < 60, 60, 0.6)


@query("agg03_weighted_vote", f"""WITH {EV}, g AS (SELECT user_id, event_type, sum(cents) AS w, count(*) AS reads FROM ev WHERE k < 30 GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT user_id, event_type, reads, w::DOUBLE / (sum(w) OVER (PARTITION BY user_id))::DOUBLE AS posterior, row_number() OVER (PARTITION BY user_id ORDER BY w DESC, event_type) AS "rank"
FROM g QUALIFY "rank" <= 3""")
def _(t: Tables):
    return votes.weighted_vote(t.ev.filter("k < 30"), ["user_id"], "event_type", F.col("cents"), 3, 3)


@query("agg04_majority", f"""WITH {EV}, c AS (SELECT user_id, event_type, count(*) AS n FROM ev GROUP BY 1, 2),
r AS (SELECT *, sum(n) OVER (PARTITION BY user_id) AS total, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS rn FROM c)
SELECT user_id, CASE WHEN n >= 10 AND n / total >= 0.25 THEN event_type END AS event_type, n AS top_votes, CAST(total AS BIGINT) AS votes FROM r WHERE rn = 1""")
def _(t: Tables):
    return votes.majority(t.ev, ["user_id"], "event_type", 10, 0.25)


@query("agg06_pool_evidence", f"""WITH {EV}, u AS (SELECT user_id, k % 7 AS label, cents * 2 AS w FROM ev WHERE event_type = 'click' UNION ALL SELECT user_id, k % 7, cents * 3 FROM ev WHERE event_type = 'view'),
g AS (SELECT user_id, label, sum(w) AS w FROM u WHERE (user_id, label) IN (SELECT user_id, k % 7 FROM ev WHERE event_type = 'signup') GROUP BY 1, 2)
SELECT user_id, label, w::DOUBLE / (sum(w) OVER (PARTITION BY user_id))::DOUBLE AS share FROM g QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY w DESC, label) = 1""")
def _(t: Tables):
    d = t.ev.withColumn("label", F.col("k") % 7)
    allowed = d.filter("event_type = 'signup'").select("user_id", "label").distinct()
    return votes.pool_evidence([(d.filter("event_type = 'click'"), 2.0), (d.filter("event_type = 'view'"), 3.0)],
                               ["user_id"], "label", "cents", allowed)


@query("agg07_top_posterior", f"""WITH {EV} SELECT user_id, k AS candidate, cents FROM ev WHERE event_type = 'view' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY cents DESC, us) = 1 AND cents >= 10000""")
def _(t: Tables):
    d = t.ev.filter("event_type = 'view'").withColumnRenamed("k", "candidate")
    return votes.top_posterior(d, ["user_id"], "candidate", "cents", ["us"], 10000)


@query("agg08_bind_cluster", f"""WITH {EV}, g AS (SELECT user_id, count_if(k < 20 AND event_id % 2 = 0) AS n0, count_if(k < 20 AND event_id % 2 = 1) AS n1 FROM ev WHERE event_type = 'signup' GROUP BY 1)
SELECT *, CASE WHEN greatest(n0, n1) >= 2 AND n0 <> n1 THEN CASE WHEN n0 > n1 THEN 0 ELSE 1 END END AS bound FROM g""")
def _(t: Tables):
    d = t.ev.filter("event_type = 'signup'").withColumn("cluster", F.col("event_id") % 2)
    return votes.bind_cluster(d, ["user_id"], "cluster", F.col("k") < 20)


@query("agg09_single_name", f"""WITH {EV}, g AS (SELECT user_id, min(CASE WHEN k >= 85 THEN k % 3 END) AS lo, max(CASE WHEN k >= 85 THEN k % 3 END) AS hi, count_if(k < 85) AS filtered FROM ev WHERE event_type = 'click' GROUP BY 1)
SELECT user_id, CASE WHEN lo = hi THEN lo END AS name, filtered, coalesce(lo <> hi, false) AS conflicted FROM g""")
def _(t: Tables):
    d = t.ev.filter("event_type = 'click'").withColumn("c", F.col("k") % 3)
    return votes.single_name(d, ["user_id"], "c", F.col("k") >= 85)


_ENDS = "CASE k % 3 WHEN 0 THEN 'left' WHEN 1 THEN 'right' END"


@query("agg10_attacked_ends", f"""WITH {EV}, s AS (SELECT user_id, us, event_id % 2 AS team, {_ENDS} AS side FROM ev WHERE event_type = 'purchase' AND k > 60),
g AS (SELECT user_id, {", ".join(f"count_if(team={m} AND side='{e}') AS {e[0]}{m}" for m in (0, 1) for e in ("left", "right"))},
  {", ".join(f"arg_min(side, us) FILTER (team={m} AND side IS NOT NULL) AS f{m}, count_if(team={m}) AS s{m}" for m in (0, 1))} FROM s GROUP BY 1),
v AS (SELECT *, CASE WHEN l0 > r0 THEN 'left' WHEN r0 > l0 THEN 'right' ELSE f0 END AS e0, CASE WHEN l1 > r1 THEN 'left' WHEN r1 > l1 THEN 'right' ELSE f1 END AS e1,
  greatest(l0, r0) AS n0, greatest(l1, r1) AS n1 FROM g),
b AS (SELECT *, CASE WHEN e0 = e1 AND n0 <= n1 THEN NULL ELSE e0 END AS b0, CASE WHEN e0 = e1 AND n1 < n0 THEN NULL ELSE e1 END AS b1 FROM v)
SELECT user_id, coalesce(b0, CASE WHEN s0 > 0 AND s1 > 0 THEN CASE b1 WHEN 'left' THEN 'right' WHEN 'right' THEN 'left' END END) AS end0,
  coalesce(b1, CASE WHEN s0 > 0 AND s1 > 0 THEN CASE b0 WHEN 'left' THEN 'right' WHEN 'right' THEN 'left' END END) AS end1 FROM b""")
def _(t: Tables):
    side = F.when(F.col("k") % 3 == 0, "left").when(F.col("k") % 3 == 1, "right")
    d = t.ev.filter("event_type = 'purchase' and k > 60").select("user_id", "us", (F.col("event_id") % 2).alias("team"), side.alias("side"))
    return votes.attacked_ends(d, ["user_id"], "team", "side", "us")


@query("agg12_stat_key", f"""WITH {EV} SELECT event_id, CASE WHEN k % 5 = 0 THEN CAST(k AS VARCHAR) WHEN event_type = 'error' OR cents % 7 = 0 THEN 'e' || user_id
  WHEN k % 2 = 0 AND k < 60 THEN CAST(k AS VARCHAR) ELSE 'e' || user_id END AS player_key FROM ev""")
def _(t: Tables):
    k, s = F.col("k"), F.col("k").cast("string")
    key = votes.stat_key(F.when(k % 5 == 0, s), F.when(k % 2 == 0, s), k < 60, F.col("event_type") == "error", F.col("cents") % 7 == 0, F.col("user_id"))
    return t.ev.select("event_id", key.alias("player_key"))


@query("agg14_positions", f"""WITH {EV}, g AS (SELECT user_id, count(*) AS samples, count_if(k >= 55) / count(*) AS perimeter, count_if(k < 18) / count(*) AS paint FROM ev GROUP BY 1 HAVING count(*) >= 50)
SELECT *, CASE WHEN perimeter >= 0.45 AND paint <= 0.20 THEN 'guard' WHEN paint >= 0.40 AND perimeter <= 0.20 THEN 'big' ELSE 'wing' END AS position FROM g""")
def _(t: Tables):
    return votes.position_descriptor(t.ev, ["user_id"], F.col("k") >= 55, F.col("k") < 18, 50)


@query("agg33_conflict_rate", f"""WITH {EV}, n AS (SELECT k % 20 AS game, user_id, event_type FROM ev GROUP BY 1, 2, 3 HAVING count(*) >= 2),
p AS (SELECT game, user_id, count(*) AS labels FROM n GROUP BY 1, 2)
SELECT game, count(*) AS tracks, count_if(labels >= 2) AS conflicted, count_if(labels >= 2) / count(*) AS rate FROM p GROUP BY 1""")
def _(t: Tables):
    return votes.conflict_rate(t.ev.withColumn("game", F.col("k") % 20), ["game"], "user_id", "event_type", 2)


@query("agg39_track_identity", f"""WITH {EV}, f AS (SELECT user_id, us // {24 * HOUR} AS d, count_if(event_type='click')::DOUBLE / count(*) AS a, count_if(event_type='view')::DOUBLE / count(*) AS b,
  count_if(event_type='purchase')::DOUBLE / count(*) AS c, count_if(event_type IN ('error','signup'))::DOUBLE / count(*) AS e FROM ev GROUP BY 1, 2),
w AS (SELECT *, CASE WHEN 1.0 - e >= 0.2 THEN (1.0 - e) * (1.0 - e) ELSE 0.0 END AS w, a + b + c AS s, greatest(a, b, c) AS m FROM f),
x AS (SELECT user_id, w, CASE WHEN s > 0 THEN greatest(ln(greatest(v / s, 0.0001)) - ln(greatest(m / s, 0.0001)), -3.0) ELSE 0.0 END AS nats, i FROM
  (SELECT user_id, w, s, m, unnest([a, b, c]) AS v, unnest([0, 1, 2]) AS i FROM w)),
sc AS (SELECT user_id, i, sum((w * nats)::DECIMAL(28,9))::DOUBLE AS s FROM x GROUP BY 1, 2),
z AS (SELECT *, exp(s - max(s) OVER (PARTITION BY user_id)) AS e FROM sc),
p AS (SELECT user_id, arg_min(i, (-s, i)) AS top, max(e) / sum(e) AS posterior FROM z GROUP BY 1),
ev2 AS (SELECT user_id, sum(w::DECIMAL(28,9))::DOUBLE AS evidence, count(*) AS frames FROM w GROUP BY 1)
SELECT user_id, top AS top_number, CASE WHEN posterior >= 0.9 AND evidence >= 1 THEN top END AS number, frames,
  CASE WHEN posterior >= 0.9 AND evidence >= 1 THEN 'identified' WHEN evidence < 1 THEN 'insufficient_evidence' ELSE 'undecided' END AS status FROM p JOIN ev2 USING (user_id)""")
def _(t: Tables):
    """Daily event shares as frame distributions (errors and signups are unreadable mass)."""
    e, n = F.col("event_type"), F.count(F.lit(1))
    f = t.ev.groupBy("user_id", F.floor(F.col("us") / F.lit(24 * HOUR)).alias("d")).agg(F.array(
        *[F.count_if(e == v).cast("double") / n for v in ("click", "view", "purchase")], F.count_if(e.isin("error", "signup")).cast("double") / n).alias("p"))
    return votes.track_identity(f, ["user_id"], "p").select("user_id", "top_number", "number", "frames", "status")


@query("ord03_top_k_tracks", f"""WITH {EV}, c AS (SELECT k % 20 AS game, user_id, count(*) AS n FROM ev GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY game ORDER BY n DESC, user_id) AS "rank" FROM c QUALIFY "rank" <= 16""")
def _(t: Tables):
    from fieldtrace.operators.ordered import top_k
    c = t.ev.groupBy((F.col("k") % 20).alias("game"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return top_k(c, ["game"], [F.col("n").desc(), F.col("user_id")], 16)


@query("ord04_tallest", f"""WITH {EV} SELECT event_id, user_id, cents, row_number() OVER (PARTITION BY user_id ORDER BY cents DESC, event_id) AS "rank" FROM ev QUALIFY "rank" <= 5""")
def _(t: Tables):
    return tracks.tallest_per_track(t.ev.select("event_id", "user_id", "cents"), ["user_id"], "cents", ["event_id"], 5)


@query("ord04_evenly_spaced", f"""WITH {EV}, n AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY us) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM ev)
SELECT event_id, user_id FROM n WHERE n <= 8 OR list_contains(list_transform(range(8), lambda j: j * (n - 1) // 7), i)""")
def _(t: Tables):
    return tracks.evenly_spaced(t.ev.select("event_id", "user_id", "us"), ["user_id"], ["us"], 8).select("event_id", "user_id")


@query("ord09_systematic", f"""WITH {EV} SELECT event_id, user_id FROM ev QUALIFY (row_number() OVER (PARTITION BY user_id ORDER BY us) - 1) % 5 = 0 AND (row_number() OVER (PARTITION BY user_id ORDER BY us) - 1) // 5 < 6""")
def _(t: Tables):
    """Every fifth appearance, six at most (the plan of a re-identification sample)."""
    return tracks.systematic_sample(t.ev.select("event_id", "user_id", "us"), ["user_id"], ["us"], 5, 6).select("event_id", "user_id")
