"""Streams over the events files drained with availableNow, and models on tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtrace.ml import models
from fieldtrace.operators import folds
from fieldtrace.plans.registry import DAY, EV, HOUR, Tables, query
from fieldtrace.sources.stage import is_folder, scratch
from fieldtrace.streaming import reorder, rules, stateful


def stream(t: Tables):
    """The events table as a file stream with the usual derived columns."""
    reader = t.spark.readStream.schema(t.events.schema)
    table = f"{t.sf_dir}/events.parquet"
    # the source reads folders: a single file is found by name in its own folder
    raw = reader.parquet(table) if is_folder(t.spark, table) else reader.option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)
    return raw.select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("ts").cast("timestamp").alias("ts"),
                      F.round(F.col("value") * 100).cast("long").alias("cents"), "value", F.get_json_object("props", "$.k").cast("long").alias("k"))


LAST = "event_id bigint, status string, held_x double, held_y double, moving_x double, moving_y double, age double"


def last_seen_rows(d):
    x = F.when(F.col("event_type") != "error", F.col("k").cast("double"))
    return d.select("user_id", (F.col("us") / HOUR).alias("t"), "event_id", x.alias("x"), F.when(x.isNotNull(), (F.col("cents") % 68).cast("double")).alias("y"))


@query("str02_last_seen", f"""WITH {EV}, o AS (SELECT event_id, user_id, us, CASE WHEN event_type <> 'error' THEN k::DOUBLE END AS x FROM ev),
f AS (SELECT *, last_value(x IGNORE NULLS) OVER w AS lx, last_value(CASE WHEN x IS NOT NULL THEN us END IGNORE NULLS) OVER w AS lu FROM o WINDOW w AS (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING))
SELECT event_id, CASE WHEN x IS NOT NULL THEN 'observed' WHEN lu IS NULL OR us / {float(HOUR)!r}::DOUBLE - lu / {float(HOUR)!r}::DOUBLE > 12 THEN 'unavailable' ELSE 'estimated' END AS status,
  CASE WHEN x IS NOT NULL THEN x WHEN lu IS NOT NULL AND us / {float(HOUR)!r}::DOUBLE - lu / {float(HOUR)!r}::DOUBLE <= 12 THEN lx END AS held_x FROM f""")
def _(t: Tables):
    """Errors are unseen frames: the last place is held for 12 h (stream)."""
    s = stateful.stream_fold(last_seen_rows(stream(t)), ["user_id"], ["t", "event_id"], rules.last_seen_rule(12.0, 6.0), LAST)
    return stateful.drain(s, scratch(t.spark)).select("event_id", "status", "held_x")


@query("str05_label_consensus", f"""WITH {EV}, d AS (SELECT event_id, user_id, us, us // {DAY} AS d, CASE WHEN k > 80 THEN k % 2 ELSE 0 END AS label FROM ev), f AS (SELECT *, row_number() OVER (PARTITION BY user_id, d ORDER BY us) = 1 AS nw FROM d)
SELECT event_id, CASE WHEN min(label) OVER w <> max(label) OVER w THEN 'conflicting' WHEN sum(nw::INT) OVER w >= 2 THEN 'supported_hypothesis' ELSE 'insufficient_evidence' END AS status FROM f WINDOW w AS (PARTITION BY user_id ORDER BY us)""")
def _(t: Tables):
    d = stream(t).select("user_id", "us", "event_id", F.floor(F.col("us") / F.lit(DAY)).alias("d"), F.when(F.col("k") > 80, F.col("k") % 2).otherwise(0).alias("label"))
    s = stateful.stream_fold(d, ["user_id"], ["us"], rules.consensus_rule("d", "label"), "event_id bigint, hypothesis string, status string")
    return stateful.drain(s, scratch(t.spark)).select("event_id", "status")


@query("str06_label_spans", f"""WITH {EV}, mk AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER w AND us - lag(us) OVER w <= {DAY} THEN 0 ELSE 1 END AS o FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us)),
rn AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY us) AS r FROM mk), g AS (SELECT user_id, r, min(event_type) AS label, min(us) AS "start", max(us) AS "end", count(*) AS n FROM rn GROUP BY 1, 2)
SELECT user_id, label, "start", "end", n FROM g QUALIFY r < max(r) OVER (PARTITION BY user_id)""")
def _(t: Tables):
    """Spans closed by a new label or a day's pause; the span still open at the end is not emitted."""
    s = stateful.stream_fold(stream(t).select("user_id", "us", "event_type"), ["user_id"], ["us"], rules.run_rule("us", "event_type", DAY), "label string, start bigint, end bigint, n bigint")
    return stateful.drain(s, scratch(t.spark)).drop("late_rows")


@query("str06_unordered_spans", f"""WITH {EV}, w AS (SELECT max(us) // 1000 - 3600000 AS wm FROM ev), f AS (SELECT ev.*, wm FROM ev, w WHERE us <= wm * 1000),
mk AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER w AND us - lag(us) OVER w <= {DAY} THEN 0 ELSE 1 END AS o FROM f WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
rn AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY us, event_id) AS r FROM mk), g AS (SELECT user_id, r, any_value(wm) AS wm, min(event_type) AS label, min(us) AS "start", max(us) AS "end", count(*) AS n FROM rn GROUP BY 1, 2)
SELECT user_id, label, "start", "end", n FROM g QUALIFY r < max(r) OVER (PARTITION BY user_id) OR wm > (max("end") OVER (PARTITION BY user_id) + 999) // 1000 + {DAY // 1000}""")
def _(t: Tables):
    """Rows wait an hour behind the newest one and go on in order of time; a user silent for a day is closed."""
    d = stream(t).select("user_id", "us", "event_id", "event_type", "ts")
    s = reorder.ordered_stream(d, ["user_id"], "ts", ["us", "event_id"], rules.run_rule("us", "event_type", DAY), "label string, start bigint, end bigint, n bigint", "1 hour", DAY // 1000)
    return stateful.drain(s, scratch(t.spark))


@query("str07_grid_windows", f"""WITH w AS (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') AS b, event_type, value, ts FROM events), m AS (SELECT max(ts) AS hi FROM events)
SELECT event_type, epoch_us(b) AS bin_us, count(*) AS n, CAST(round(max(value) * 100) AS BIGINT) AS top FROM w, m WHERE b + INTERVAL 6 HOUR <= hi GROUP BY 1, 2""")
def _(t: Tables):
    """Six-hour tumbling bins per event type, emitted once the watermark passes them."""
    s = stateful.grid_counts(stream(t), ["event_type"], "ts", "6 hours", "0 seconds")
    d = stateful.drain(s, scratch(t.spark))
    return d.select("event_type", F.unix_micros("bin_start").alias("bin_us"), "n", F.round(F.col("top") * 100).cast("long").alias("top"))


@query("str01_online_association")
def _(t: Tables):
    """Detections of each user's day associated online (stream over frames built from the files)."""
    e = t.ev.filter("event_type <> 'error'")
    k = F.col("k").cast("double")
    det = F.struct(F.col("event_id").alias("id"), (F.col("k") % 2).alias("cls"), k.alias("x1"), F.lit(0.0).alias("y1"), (k + 40).alias("x2"), F.lit(60.0).alias("y2"), F.lit(None).cast("array<double>").alias("colour"))
    frames = e.groupBy("user_id", F.floor(F.col("us") / F.lit(12 * HOUR)).alias("f")).agg(F.array_sort(F.collect_list(det)).alias("detections"))
    frames = frames.select("user_id", (F.col("f") * 0.3).alias("t"), F.floor(F.col("f") / 20).alias("shot"), "detections")
    path = scratch(t.spark)
    frames.write.parquet(path)
    live = t.spark.readStream.schema(frames.schema).parquet(path)
    s = stateful.stream_fold(live, ["user_id"], ["t"], rules.association_rule(), "id bigint, track_id bigint, t double")
    return stateful.drain(s, scratch(t.spark))


@query("str01_batch_twin")
def _(t: Tables):
    """The association rule as a batch fold."""
    e = t.ev.filter("event_type <> 'error'")
    k = F.col("k").cast("double")
    det = F.struct(F.col("event_id").alias("id"), (F.col("k") % 2).alias("cls"), k.alias("x1"), F.lit(0.0).alias("y1"), (k + 40).alias("x2"), F.lit(60.0).alias("y2"), F.lit(None).cast("array<double>").alias("colour"))
    frames = e.groupBy("user_id", F.floor(F.col("us") / F.lit(12 * HOUR)).alias("f")).agg(F.array_sort(F.collect_list(det)).alias("detections"))
    frames = frames.select("user_id", (F.col("f") * 0.3).alias("t"), F.floor(F.col("f") / 20).alias("shot"), "detections")
    return folds.fold(frames, ["user_id"], ["t"], rules.association_rule(), "id bigint, track_id bigint, t double")


@query("str03_confirmed_object")
def _(t: Tables):
    """One object per user: views are candidate positions, six hours a tick of 0.1 s."""
    c = F.struct(F.col("k").cast("double").alias("x"), (F.col("cents") % 50).cast("double").alias("y"), (F.col("cents") % 100 / 100.0).alias("score"))
    f = t.ev.groupBy("user_id", F.floor(F.col("us") / F.lit(6 * HOUR)).alias("f")).agg(F.array_sort(F.collect_list(F.when(F.col("event_type") == "view", c))).alias("candidates"))
    return folds.fold(f.select("user_id", (F.col("f") * 0.1).alias("t"), "candidates"), ["user_id"], ["t"], rules.ball_rule(400.0),
                      "t double, status string, x double, y double, selected bigint, age double")


@query("str04_camera_guard")
def _(t: Tables):
    """Camera checks per user and day: the people are the day's events, the camera shifts with their mean."""
    f = t.ev.groupBy("user_id", F.floor(F.col("us") / F.lit(2 * DAY)).alias("f")).agg(F.collect_list(F.struct(F.col("k").cast("double").alias("x"), (F.col("cents") % 60).cast("double").alias("y"))).alias("feet"), F.max("k").alias("top"))
    h = F.array(*[F.lit(v) if v is not None else -(F.col("top") / 2.0) for v in (0.4, 0.0, None, 0.0, 0.4, -12.0, 0.0, 0.0, 1.0)])
    d = f.select("user_id", (F.col("f") * 1.0).alias("t"), (F.col("top") > 20).alias("accepted"), F.lit(None).cast("string").alias("reason"), h.alias("h"), "feet")
    return folds.fold(rules.camera_faults(d).drop("accepted", "reason"), ["user_id"], ["t"], rules.camera_rule(), "t double, accepted boolean, reason string")


@query("str08_work_queue", f"WITH {EV} SELECT user_id, 'n=' || count(*) AS note FROM ev WHERE user_id % 7 <> 0 GROUP BY 1")
def _(t: Tables):
    """Users as jobs: run once (a second drain finds nothing to do); multiples of seven are parked."""
    done, parked = scratch(t.spark), scratch(t.spark)
    totals = t.ev.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n"))

    def work(jobs):
        return jobs.join(totals, "user_id").select("user_id", F.concat(F.lit("n="), F.col("_n")).alias("note"), (F.col("user_id") % 7 != 0).alias("ok"))

    for _ in range(2):
        stateful.work_queue(stream(t).select("user_id"), done, parked, work, ["user_id"], scratch(t.spark)).awaitTermination()
    return t.spark.read.parquet(done).drop("batch")


@query("str09_append_revisions", f"""WITH {EV}, s AS (SELECT user_id, event_id, k % 3 AS i, min(event_id) OVER (PARTITION BY user_id, k % 3) AS f FROM ev)
SELECT user_id AS run, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY f, i, event_id) AS revision FROM s""")
def _(t: Tables):
    """Imports appended through a stream; sending the same imports again changes nothing."""
    log = scratch(t.spark)
    d = stream(t).select(F.col("user_id").alias("run"), F.concat(F.lit("imp-"), (F.col("k") % 3).cast("string")).alias("source_key"), F.col("event_id").alias("seq"), F.col("cents").cast("string").alias("payload"))
    for _ in range(2):
        cp = scratch(t.spark)
        q = d.writeStream.foreachBatch(lambda b, e, cp=cp: stateful.append_revisions(b, log, name=stateful.batch_name(cp, e))).option("checkpointLocation", cp).trigger(availableNow=True).start()
        q.awaitTermination()
    return t.spark.read.parquet(log).select("run", "seq", "revision")


def features(t: Tables):
    d = t.ev.select("event_id", "user_id", F.col("k").cast("double").alias("k"), (F.col("cents") / 100.0).alias("v"), F.pmod(F.floor(F.col("us") / F.lit(HOUR)), F.lit(24)).cast("double").alias("hour"), "event_type",
                    ((F.col("k") + F.col("cents") % 37) > 70).cast("int").alias("label"))
    return d.filter("user_id % 2 = 0"), d.filter("user_id % 2 = 1")


@query("ml01_progression_forest")
def _(t: Tables):
    train, test = features(t)
    m = models.forest(train, ["k", "v", "hour"], "label")
    prior = train.agg(F.avg("label")).first()[0]
    return models.against_prior(models.score(m, test), "label", float(prior))


@query("ml02_next_action_forest")
def _(t: Tables):
    """Multi-class forest with balanced weights; counts per predicted class."""
    train, test = features(t)
    m = models.forest(models.class_weights(train, "event_type"), ["k", "v", "hour"], "event_type", trees=120, weight="weight")
    return m.transform(test).groupBy("_pred").agg(F.count(F.lit(1)).alias("n"))


@query("ml03_logistic_path")
def _(t: Tables):
    train, test = features(t)
    _, c, m = models.logistic_path(train, test.filter("user_id % 4 = 1"), ["k", "v", "hour"], "label")
    from fieldtrace.operators.metrics import probability_metrics
    return probability_metrics(models.score(m, test.filter("user_id % 4 = 3")), [], "score", F.col("label") == 1).withColumn("c", F.lit(c))


@query("ml04_shot_ranker")
def _(t: Tables):
    train, test = features(t)
    d = train.unionByName(test).withColumn("w", F.lit(1.0) + F.col("v") / 100.0)
    _, s = models.shot_ranker(d, ["k", "v", "hour"], "label", "w", "user_id")
    return s.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"))


@query("ml05_team_clusters")
def _(t: Tables):
    """Vectors of each label clustered into three."""
    return models.team_clusters(t.embeddings.select("label", "vec_id", "embedding"), ["label"], "vec_id", "embedding")
