"""Sequential rules over the event stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtrace.operators import folds
from fieldtrace.plans.registry import DAY, EV, HOUR, Tables, query


@query("win07_min_gap", f"""WITH RECURSIVE {EV}, o AS (SELECT event_id, user_id, us FROM ev),
f AS (SELECT user_id, min(us) AS us FROM o GROUP BY 1 UNION ALL
  SELECT f.user_id, (SELECT min(o.us) FROM o WHERE o.user_id = f.user_id AND o.us >= f.us + {DAY}) FROM f
  WHERE EXISTS (SELECT 1 FROM o WHERE o.user_id = f.user_id AND o.us >= f.us + {DAY}))
SELECT o.user_id, o.event_id, o.us FROM o JOIN f ON f.user_id = o.user_id AND f.us = o.us""")
def _(t: Tables):
    """Keep an event when a day has passed since the last kept one."""
    return folds.min_gap_sample(t.ev.select("user_id", "event_id", "us"), ["user_id"], ["us"], DAY)


@query("win02_team_runs", f"""WITH RECURSIVE {EV}, o AS (SELECT user_id, us AS t0, us + k * {HOUR // 4} AS t1, CASE WHEN k % 3 <> 0 THEN CASE WHEN event_type IN ('click','view') THEN 0 ELSE 1 END END AS team,
  row_number() OVER (PARTITION BY user_id ORDER BY us) AS i FROM ev),
f AS (SELECT user_id, i, 1::BIGINT AS run, t0 AS r0, t1 AS r1, team FROM o WHERE i = 1 UNION ALL
  SELECT o.user_id, o.i, CASE WHEN (o.team IS NULL OR f.team IS NULL OR o.team = f.team) AND o.t0 - f.r1 <= {20 * HOUR} THEN f.run ELSE f.run + 1 END,
    CASE WHEN (o.team IS NULL OR f.team IS NULL OR o.team = f.team) AND o.t0 - f.r1 <= {20 * HOUR} THEN f.r0 ELSE o.t0 END,
    CASE WHEN (o.team IS NULL OR f.team IS NULL OR o.team = f.team) AND o.t0 - f.r1 <= {20 * HOUR} THEN greatest(f.r1, o.t1) ELSE o.t1 END,
    CASE WHEN (o.team IS NULL OR f.team IS NULL OR o.team = f.team) AND o.t0 - f.r1 <= {20 * HOUR} THEN coalesce(f.team, o.team) ELSE o.team END
  FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1)
SELECT user_id, max(r0) AS t0, max(r1) AS t1, arg_max(team, i) AS team, count(*) AS contacts FROM f GROUP BY user_id, run""")
def _(t: Tables):
    e, k = F.col("event_type"), F.col("k")
    d = t.ev.select("user_id", F.col("us").alias("t0"), (F.col("us") + k * (HOUR // 4)).alias("t1"),
                    F.when(k % 3 != 0, F.when(e.isin("click", "view"), 0).otherwise(1)).alias("team"))
    return folds.team_runs(d, ["user_id"], 20 * HOUR)


@query("win03_merge_windows", f"""WITH RECURSIVE {EV}, o AS (SELECT user_id, event_id AS frame, us AS ts, CASE WHEN k % 4 < 2 THEN CASE k % 4 WHEN 0 THEN 'left' ELSE 'right' END END AS e, k::DOUBLE AS x1,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM ev),
f AS (SELECT user_id, i, 1::BIGINT AS w, frame AS f0, ts AS t0, ts AS t1, e, x1, x1 + 10.0::DOUBLE AS x2 FROM o WHERE i = 1 UNION ALL
  SELECT o.user_id, o.i, CASE WHEN m THEN f.w ELSE f.w + 1 END, CASE WHEN m THEN f.f0 ELSE o.frame END, CASE WHEN m THEN f.t0 ELSE o.ts END, o.ts,
    CASE WHEN m THEN coalesce(f.e, o.e) ELSE o.e END, CASE WHEN m THEN least(f.x1, o.x1) ELSE o.x1 END, CASE WHEN m THEN greatest(f.x2, o.x1 + 10) ELSE o.x1 + 10 END
  FROM (SELECT f.*, (f.e IS NULL OR n.e IS NULL OR f.e = n.e) AND n.ts - f.t1 <= {20 * HOUR} AND n.ts - f.t0 <= {48 * HOUR} AS m FROM f JOIN o n ON n.user_id = f.user_id AND n.i = f.i + 1) f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1)
SELECT user_id, max(f0) AS frame_start, max(t0) AS ts_start, max(t1) AS ts_end, arg_max(e, i) AS court_end, count(*) AS n_obs, arg_max(x1, i) AS x1, arg_max(x2, i) AS x2 FROM f GROUP BY user_id, w""")
def _(t: Tables):
    k = F.col("k")
    x = k.cast("double")
    d = t.ev.select("user_id", F.col("event_id").alias("frame"), F.col("us").alias("ts"), F.when(k % 4 == 0, "left").when(k % 4 == 1, "right").alias("court_end"),
                    x.alias("x1"), x.alias("y1"), (x + 10).alias("x2"), (x + 10).alias("y2"))
    return folds.merge_windows(d, ["user_id"], 20 * HOUR, 48 * HOUR).select(
        "user_id", "frame_start", "ts_start", "ts_end", "court_end", "n_obs", "x1", "x2")


@query("win28_peaks", f"""WITH RECURSIVE {EV}, o AS (SELECT user_id, event_id AS bin, cents, max(cents) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 40 PRECEDING AND 40 FOLLOWING) AS top FROM ev),
p AS (SELECT user_id, bin, cents FROM o WHERE cents >= 3000 AND cents >= top),
f AS (SELECT user_id, min(bin) AS bin FROM p GROUP BY 1 UNION ALL SELECT f.user_id, (SELECT min(bin) FROM p WHERE p.user_id = f.user_id AND p.bin >= f.bin + 40) FROM f
  WHERE EXISTS (SELECT 1 FROM p WHERE p.user_id = f.user_id AND p.bin >= f.bin + 40))
SELECT p.user_id, p.bin, p.cents FROM p JOIN f ON f.user_id = p.user_id AND f.bin = p.bin""")
def _(t: Tables):
    d = t.ev.select("user_id", F.col("event_id").alias("bin"), "cents")
    return folds.peaks(d, ["user_id"], "bin", "cents", 3000, 40)


@query("win31_score_steps", f"""WITH RECURSIVE {EV}, o AS (SELECT user_id, us AS t, k // 10 AS b, k // 10 + cents % 5 AS a, row_number() OVER (PARTITION BY user_id ORDER BY us) AS i FROM ev),
f AS (SELECT user_id, 0::BIGINT AS i, NULL::BIGINT AS last, false AS ok FROM (SELECT DISTINCT user_id FROM o) UNION ALL
  SELECT o.user_id, o.i, CASE WHEN a - b IN (1,2,3) AND (last IS NULL OR b >= last) THEN a ELSE last END, a - b IN (1,2,3) AND (last IS NULL OR b >= last) FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1)
SELECT o.user_id, t, b AS before, a AS after, a - b AS delta FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i WHERE f.ok""")
def _(t: Tables):
    b = F.floor(F.col("k") / 10)
    d = t.ev.select("user_id", F.col("us").alias("t"), b.alias("before"), (b + F.col("cents") % 5).alias("after"))
    return folds.score_steps(d, ["user_id"])


@query("win32_countdown")
def _(t: Tables):
    """Clock readings (k plus jumps) as a countdown with confirmed periods; literal cases are unit-tested."""
    d = t.ev.filter("event_type <> 'error'").select("user_id", F.col("us").alias("t"), (F.lit(1200) - F.col("event_id") % 1200 + F.col("k") % 7).alias("clock"))
    return folds.countdown_timeline(d, ["user_id"])


@query("win33_chains")
def _(t: Tables):
    """Candidates chained within 12 h and 25 units; chains of three that spread stay."""
    d = t.ev.select("user_id", (F.col("us") / HOUR).alias("t"), F.col("k").cast("double").alias("x"), (F.col("cents") % 100).cast("double").alias("y"), F.col("event_id").alias("id"))
    c = folds.chain_candidates(d, ["user_id"], 12.0, 25.0)
    anchored = t.ev.filter("event_type = 'view'").select(F.col("event_id").alias("id"))
    return folds.believed_chains(c, ["user_id"], anchored, 3, 20.0, 10.0)


@query("win22_possession_intervals")
def _(t: Tables):
    """Possessions of a user's stream: views and clicks control, purchases end, errors are dead balls."""
    kind = (F.when(F.col("event_type") == "view", "PASS").when(F.col("event_type") == "click", "RECOVERY").when(F.col("event_type") == "signup", "SET PIECE")
            .when(F.col("event_type") == "purchase", "SHOT").otherwise("BALL OUT"))
    period = F.floor(F.col("us") / F.lit(7 * DAY)).cast("int")
    d = t.ev.select("user_id", (F.col("us") / 1e6).alias("t"), F.col("event_id").alias("seq"), period.alias("period"),
                    (F.col("k") % 2).cast("int").alias("team"), kind.alias("kind"), ((period + 1) * (7 * DAY / 1e6)).alias("period_end"))
    return folds.possession_intervals(d, ["user_id"])


@query("win10_fused_track")
def _(t: Tables):
    """Two sensors (clicks and views) fused into one gated track per user; frame = six-hour slot."""
    d = t.ev.filter("event_type in ('click', 'view')").select(
        "user_id", F.floor(F.col("us") / F.lit(6 * HOUR)).alias("frame"), F.when(F.col("event_type") == "click", "det").otherwise("heat").alias("sensor"),
        F.col("k").cast("double").alias("x"), (F.col("cents") % 100).cast("double").alias("y"), ((F.col("cents") % 97) / 97.0).alias("conf"))
    return folds.bridge_segments(folds.fuse_track(d, ["user_id"]), ["user_id"])


@query("win35_lock_sweep")
def _(t: Tables):
    """Daily segments of each court attached to identity locks by vector, motion and team."""
    e = t.embeddings.select(F.col("vec_id").alias("v_id"), "embedding")
    d = t.ev.filter("event_type = 'view'").select(
        (F.col("user_id") % 25).alias("court"), F.col("event_id").alias("segment"), (F.col("us") / 1e3).alias("t0"), (F.col("us") / 1e3 + 5e5).alias("t1"),
        (F.col("k") % 2).alias("team"), F.col("k").cast("double").alias("fx"), F.col("k").cast("double").alias("fy"), (F.col("us") / 1e3 + 5e5).alias("t_last"),
        F.col("k").cast("double").alias("cx"), F.col("k").cast("double").alias("cy"), F.lit(10.0).alias("h"), F.lit(0.0).alias("vx"), F.lit(0.0).alias("vy"),
        (F.col("user_id") % 500).alias("v_id"))
    d = d.join(e, "v_id", "left").withColumn("gallery", F.when(F.col("embedding").isNotNull() & (F.col("segment") % 5 != 0), F.array(
        F.struct(F.lit(1.0).alias("q"), F.col("embedding").cast("array<double>").alias("v")))))
    return folds.sweep_locks(d, ["court"])


@query("win36_bidirectional_seekers")
def _(t: Tables):
    """Boxes of each court tracked forward and backward; a tick is half an hour squeezed to 100 ms."""
    from fieldtrace.operators.seekers import bidirectional
    x = (F.col("k") * 10).cast("double")
    d = t.ev.select((F.col("user_id") % 20).alias("court"), (F.floor(F.col("us") / F.lit(6 * HOUR)) * 100).alias("t"), F.floor(F.col("us") / F.lit(6 * HOUR)).alias("frame"), F.col("event_id").alias("det"),
                    x.alias("x1"), F.lit(0.0).alias("y1"), (x + 40).alias("x2"), F.lit(120.0).alias("y2"))
    return bidirectional(d, ["court"])
