"""Stages, provider files and label corpora written from the driver tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtrace.operators import quality, splits
from fieldtrace.plans.registry import DAY, EV, HOUR, Tables, query
from fieldtrace.sources import labels, stage, tracking


@query("src01_stage_round_trip", f"WITH {EV} SELECT user_id, event_type, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM ev GROUP BY 1, 2")
def _(t: Tables):
    """SRC-01/02: typed zstd stage written and read back (refused unless complete)."""
    path = stage.scratch(t.spark)
    stage.write_stage(t.ev, path)
    return stage.read_stage(t.spark, path).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))


@query("src03_resume", f"WITH {EV} SELECT event_type, count(*) AS n FROM ev GROUP BY 1")
def _(t: Tables):
    """SRC-03: the second call finds the stage complete and does not build it."""
    path = stage.scratch(t.spark)
    stage.ensure_stage(t.spark, path, lambda: t.ev.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")))

    def fail():
        raise AssertionError("a complete stage was rebuilt")

    return stage.ensure_stage(t.spark, path, fail)


@query("src04_discover_games", f"WITH {EV} SELECT DISTINCT (user_id % 20)::INTEGER AS game_key FROM ev")
def _(t: Tables):
    path = stage.scratch(t.spark)
    d = t.ev.select((F.col("user_id") % 20).alias("game_key"), "us", "event_type")
    stage.write_stage(d.repartition("game_key"), path, by=["game_key"])
    return stage.discover_games(t.spark, path)


@query("src05_pending", f"WITH {EV} SELECT DISTINCT user_id, us // {DAY} AS d FROM ev WHERE event_type = 'view' AND (user_id, us // {DAY}) NOT IN (SELECT user_id, us // {DAY} FROM ev WHERE event_type = 'purchase')")
def _(t: Tables):
    d = t.ev.withColumn("d", F.floor(F.col("us") / F.lit(DAY)))
    return stage.pending(d.filter("event_type = 'view'").select("user_id", "d").distinct(), d.filter("event_type = 'purchase'"), ["user_id", "d"])


@query("src07_provider_observations", f"""WITH {EV}, p AS (SELECT user_id % 30 AS game, us // {DAY} AS frame, event_type AS player, arg_min(k, us) AS x FROM ev GROUP BY 1, 2, 3),
f AS (SELECT DISTINCT game, frame FROM p), r AS (SELECT DISTINCT game, player FROM p)
SELECT f.game, f.frame, r.player, p.x AS x_m, CASE WHEN p.x IS NULL THEN 'unavailable' ELSE 'observed' END AS status FROM f JOIN r USING (game) LEFT JOIN p ON p.game=f.game AND p.frame=f.frame AND p.player=r.player""")
def _(t: Tables):
    g = t.ev.groupBy((F.col("user_id") % 30).alias("game"), F.floor(F.col("us") / F.lit(DAY)).alias("frame"), F.col("event_type").alias("player")).agg(F.min_by("k", "us").alias("x_m"))
    d = g.select("game", F.lit(1).alias("period"), "frame", F.col("frame").cast("double").alias("time_s"), "player", F.lit(0).alias("team"), "x_m", F.lit(1.0).alias("y_m"))
    return tracking.provider_observations(d, ["game"]).select("game", "frame", "player", "x_m", "status")


@query("src08_skillcorner", f"""WITH {EV}, e AS (SELECT us // {HOUR} AS frame, event_type, user_id, k::DOUBLE AS x, cents FROM ev),
p AS (SELECT frame, user_id, v.x AS x, v.d AS det FROM (SELECT frame, user_id, arg_min({{'x': CASE WHEN cents % 5 <> 0 THEN x END, 'd': event_type = 'view'}}, (event_type, x)) AS v FROM e GROUP BY 1, 2)),
pl AS (SELECT user_id, us // {HOUR} - 24 AS a, us // {HOUR} + 24 AS b FROM ev WHERE event_type = 'signup'), ex AS (SELECT DISTINCT f.frame, pl.user_id FROM (SELECT DISTINCT frame FROM p) f JOIN pl ON f.frame >= a AND f.frame < b),
z AS (SELECT coalesce(p.user_id, ex.user_id) AS user_id, x, det FROM p FULL JOIN ex ON p.frame = ex.frame AND p.user_id = ex.user_id)
SELECT count(*) AS n, count_if(x IS NULL) AS unavailable, count_if(x IS NOT NULL AND det) AS detected, count_if(x IS NOT NULL AND NOT det) AS extrapolated, count_if(user_id % 2 = 0 AND user_id IN (SELECT user_id FROM pl)) AS team_a, count_if(user_id NOT IN (SELECT user_id FROM pl)) AS no_team FROM z""")
def _(t: Tables):
    """JSON-lines frames (one per hour) read with the provider schema; a user is expected from the day before to the day after each signup."""
    e = t.ev.select(F.floor(F.col("us") / F.lit(HOUR)).cast("int").alias("frame"), "event_id", "event_type", "user_id", F.col("k").cast("double").alias("x"), "cents")
    p = e.groupBy("frame", "user_id").agg(F.min_by(F.struct(F.when(F.col("cents") % 5 != 0, F.col("x")).alias("x"), (F.col("event_type") == "view").alias("d")), F.struct("event_type", "x", "event_id")).alias("_v"))  # the SQL keeps the first row of a tie
    frames = p.groupBy("frame").agg(F.collect_list(F.struct(F.col("user_id").alias("player_id"), F.col("_v.x").alias("x"), F.col("_v.x").alias("y"), F.col("_v.d").alias("is_detected"))).alias("player_data"))
    path = stage.scratch(t.spark)
    frames.select("frame", F.lit(1).alias("period"), F.lit("0:00:01.00").alias("timestamp"), "player_data").write.json(path)
    hour = F.floor(F.col("us") / F.lit(HOUR)).cast("int")
    playing = t.ev.filter("event_type = 'signup'").select(F.col("user_id").alias("player_id"), F.when(F.col("user_id") % 2 == 0, "a").otherwise("b").alias("team_id"), (hour - 24).alias("start_frame"), (hour + 24).alias("end_frame"))
    o = tracking.skillcorner_observations(tracking.skillcorner_frames(t.spark, path), playing).filter("entity = 'player'")
    return o.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("status") == s).alias(s) for s in ("unavailable", "detected", "extrapolated")], F.count_if(F.col("team_id") == "a").alias("team_a"), F.count_if(F.col("team_id").isNull()).alias("no_team"))


@query("src09_typed_events", f"WITH {EV} SELECT event_id, CASE WHEN k % 10 <> 0 THEN cents::DOUBLE END AS cents, 'm1:' || event_id AS event_uid FROM ev")
def _(t: Tables):
    """CSV read as strings, typed afterwards; unreadable numbers become null."""
    path = stage.scratch(t.spark)
    t.ev.select(F.col("event_id").cast("string").alias("event_id"), F.when(F.col("k") % 10 != 0, F.col("cents").cast("string")).otherwise("n/a").alias("cents")).write.option("header", True).csv(path)
    raw = t.spark.read.option("header", True).schema("event_id string, cents string").csv(path)
    return tracking.typed_events(raw, "m1", ["event_id"], ["cents"])


@query("src10_gsr_labels", f"WITH {EV} SELECT event_id AS frame, k AS track_id, (k + 10)::DOUBLE AS x2, (event_id - 1) / 25.0::DOUBLE AS timestamp_s, k % 2 = 0 AS scored FROM ev WHERE event_type = 'view'")
def _(t: Tables):
    """One label document per user: events are images, views carry object annotations."""
    name = F.concat(F.lpad(F.col("event_id").cast("string"), 9, "0"), F.lit(".jpg"))
    ident = F.col("event_id").cast("string")
    image = F.struct(ident.alias("image_id"), name.alias("file_name"), (F.col("k") % 2 == 0).alias("has_labeled_person"), F.lit(True).alias("has_labeled_pitch"), F.lit(True).alias("has_labeled_camera"))
    note = F.struct(ident.alias("id"), ident.alias("image_id"), F.col("k").alias("track_id"), F.when(F.col("event_type") == "view", "object").otherwise("pitch").alias("supercategory"),
                    F.struct(F.col("k").cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(10.0).alias("w"), F.lit(5.0).alias("h")).alias("bbox_image"))
    path = stage.scratch(t.spark)
    t.ev.groupBy("user_id").agg(F.struct(F.lit(25.0).alias("frame_rate")).alias("info"), F.collect_list(image).alias("images"), F.collect_list(note).alias("annotations")).write.json(path)
    frames, objects = tracking.gsr_labels(t.spark, path, multi_line=False)
    d = objects.join(frames.select("sequence", "frame", "timestamp_s", "scored"), ["sequence", "frame"])
    return d.select(F.col("frame").cast("long").alias("frame"), "track_id", "x2", "timestamp_s", "scored")


@query("src11_mot_rows", """SELECT l_orderkey AS seq, l_linenumber AS frame, l_partkey AS track_id, l_quantity AS x1, l_quantity + (l_quantity - 5) AS x2, l_discount AS conf FROM lineitem WHERE l_quantity > 5""")
def _(t: Tables):
    path = stage.scratch(t.spark)
    q = F.col("l_quantity")
    cols = [F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), q, F.col("l_linenumber"), q - 5, F.lit(7.5), F.col("l_discount")]
    t.lineitem.select(*[c.cast("string").alias(f"x{i}") for i, c in enumerate(cols)]).write.csv(path)
    raw = t.spark.read.schema("seq bigint, " + ", ".join(f"c{i} string" for i in range(7))).csv(path)
    return tracking.mot_rows(raw, False, ["seq"]).select("seq", "frame", "track_id", "x1", "x2", "conf")


@query("src11_frame_spine", "SELECT o_orderkey, unnest(range(1, (o_orderkey % 4 + 1) + 1)) AS frame FROM orders")
def _(t: Tables):
    n = t.orders.select("o_orderkey", (F.col("o_orderkey") % 4 + 1).alias("n"))
    return tracking.mot_spine(n, ["o_orderkey"], "n").select("o_orderkey", F.col("frame").cast("long").alias("frame"))


@query("src12_plays", """SELECT CAST(conv_id AS VARCHAR) || '-' || turn AS play_id, (turn * 60 + conv_id % 60)::DOUBLE AS clock_s, role AS type_text, 'J' || (turn % 3) AS shooter_jersey, turn % 2 = 0 AS shooting_play FROM conversations""")
def _(t: Tables):
    """Conversations as play-by-play documents: turns are plays, roles the play types."""
    c = t.conversations
    play = F.struct(F.concat_ws("-", F.col("conv_id"), F.col("turn")).alias("id"), F.struct(F.lit(1).alias("number")).alias("period"),
                    F.struct(F.concat_ws(":", F.col("turn").cast("string"), F.lpad((F.col("conv_id") % 60).cast("string"), 2, "0")).alias("displayValue")).alias("clock"), F.struct(F.col("role").alias("text")).alias("type"), F.lit("x").alias("text"),
                    (F.col("turn") % 2 == 0).alias("shootingPlay"), F.array(F.struct(F.struct(F.concat(F.lit("a"), F.col("turn") % 3).alias("id")).alias("athlete"))).alias("participants"))
    ath = F.array(*[F.struct(F.struct(F.lit(f"a{i}").alias("id"), F.lit(f"J{i}").alias("jersey")).alias("athlete")) for i in range(3)])
    doc = c.groupBy("conv_id").agg(F.collect_list(play).alias("plays")).select(
        F.struct(F.col("conv_id").cast("string").alias("id")).alias("header"), "plays", F.struct(F.array(F.struct(F.array(F.struct(ath.alias("athletes"))).alias("statistics"))).alias("players")).alias("boxscore"))
    path = stage.scratch(t.spark)
    doc.write.json(path)
    d = labels.pbp_plays(labels.pbp_documents(t.spark, path, multi_line=False))
    return d.select("play_id", "clock_s", "type_text", "shooter_jersey", "shooting_play")


@query("src13_corpus_index", """SELECT CAST(o_orderkey AS VARCHAR) AS event_id, strftime(o_orderdate, '%Y%m%d') AS date FROM orders WHERE o_custkey % 4 <> 0""")
def _(t: Tables):
    """Orders as summaries of two sides; a summary with one location is left out."""
    side = lambda a: F.struct(F.struct(a.alias("location"), F.concat(a, F.lit(" U")).alias("displayName")).alias("team"))
    other = F.when(F.col("o_custkey") % 4 == 0, "A").otherwise("B")
    comp = F.struct(F.col("o_orderkey").cast("string").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm'Z'").alias("date"), F.array(side(F.lit("A")), side(other)).alias("competitors"))
    path = stage.scratch(t.spark)
    t.orders.select(F.struct(F.col("o_orderkey").cast("string").alias("id"), F.array(comp).alias("competitions")).alias("header")).write.json(path)
    return labels.corpus_index(labels.pbp_documents(t.spark, path, multi_line=False)).select("event_id", "date")


@query("src14_merge_coco", f"""WITH {EV}, b AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS source, CASE WHEN user_id % 5 = 0 THEN 'test' ELSE 'train' END AS s, user_id AS i, CASE event_type WHEN 'view' THEN 'player' WHEN 'click' THEN 'ball' END AS category FROM ev),
im AS (SELECT source, s, i, row_number() OVER (ORDER BY source, s, i) AS image_no FROM (SELECT DISTINCT source, s, i FROM b WHERE category IS NOT NULL))
SELECT image_no, category, count(*) AS n FROM b JOIN im USING (source, s, i) WHERE category IS NOT NULL GROUP BY 1, 2""")
def _(t: Tables):
    split = F.when(F.col("user_id") % 5 == 0, "test").otherwise("train").alias("split")
    src = {}
    for name, r in (("a", 0), ("b", 1)):
        e = t.ev.filter(F.col("event_id") % 2 == r)
        im = e.select(split, F.col("user_id").alias("image_id"), F.col("user_id").cast("string").alias("file_name")).distinct()
        bx = e.select(split, F.col("user_id").alias("image_id"), F.col("event_type").alias("category"), F.col("k").cast("double").alias("x"), F.col("event_id").cast("double").alias("y"), F.lit(1.0).alias("w"), F.lit(1.0).alias("h"))
        src[name] = (im, bx, {"view": "player", "click": "ball"})
    boxes = labels.merge_coco(src)[1]
    return boxes.groupBy("image_no", "category").agg(F.count(F.lit(1)).alias("n"))


@query("src15_split_leaks", f"WITH {EV} SELECT user_id, list_sort(list(DISTINCT event_type)) AS splits FROM ev WHERE event_type IN ('view', 'signup') GROUP BY 1 HAVING count(DISTINCT event_type) > 1")
def _(t: Tables):
    d = t.ev
    return labels.export_splits({n: d.filter(F.col("event_type") == n).select("user_id") for n in ("view", "signup")}, "user_id")[1]


@query("src16_result_documents", """SELECT c_nationkey AS job_id, count(*) AS lines, CAST(sum(CAST(round(c_acctbal*100) AS BIGINT)) AS BIGINT) AS points FROM customer GROUP BY 1""")
def _(t: Tables):
    """One JSON document per nation, parsed back."""
    box = t.customer.select(F.col("c_nationkey").alias("job_id"), F.lit(0).alias("team"), F.col("c_name").alias("player_key"), F.lit(1).alias("entity_id"), F.round(F.col("c_acctbal") * 100).cast("long").alias("points"), F.lit(1.0).alias("confidence"))
    ev = t.customer.select(F.col("c_nationkey").alias("job_id"), F.col("c_custkey").alias("ts_ms"), F.lit("FGA").alias("event_type"))
    d = labels.result_documents(box, ev).withColumn("d", F.from_json("document", "struct<totals:struct<points:bigint>, players:array<struct<player_key:string>>>"))
    return d.select("job_id", F.size("d.players").cast("long").alias("lines"), F.col("d.totals.points").alias("points"))


@query("src17_results_to_shots", f"""WITH {EV}, e AS (SELECT user_id, us, CASE WHEN event_type='view' THEN 'attempt' ELSE 'made' END AS kind FROM ev WHERE event_type IN ('view','purchase')),
n AS (SELECT *, lead(kind) OVER (PARTITION BY user_id ORDER BY us) AS nk, lead(us) OVER (PARTITION BY user_id ORDER BY us) AS nu FROM e)
SELECT user_id AS player, us AS ts_ms, coalesce(nk = 'made', false) AS made, CASE WHEN nk = 'made' THEN nu END AS made_ts FROM n WHERE kind = 'attempt'""")
def _(t: Tables):
    e = t.ev.filter("event_type in ('view', 'purchase')").select(F.lit(1).alias("job_id"), F.lit(0).alias("team"), F.col("user_id").alias("player"), F.col("us").alias("ts_ms"), F.col("event_id").alias("seq"),
                                                               F.when(F.col("event_type") == "view", "attempt").otherwise("made").alias("kind"))
    return labels.results_to_shots(e).select("player", "ts_ms", "made", "made_ts")


@query("src18_keyframes")
def _(t: Tables):
    ent = t.ev.filter("event_type = 'purchase'").select("user_id").distinct()
    return labels.entity_keyframes(t.ev.select("user_id", "us", "k"), ent, [], "user_id", "us", DAY)


@query("src18_document")
def _(t: Tables):
    """One document of keyframes per user, by entity."""
    boxes = t.ev.select("user_id", (F.col("k") % 5).alias("entity"), "us", "k")
    frames = labels.entity_keyframes(boxes, boxes.select("user_id", "entity").distinct(), ["user_id"], "entity", "us", DAY)
    return labels.keyframe_documents(frames, ["user_id"], "entity", ["us", "k"])


@query("src20_cache_latest", f"WITH {EV} SELECT sha256(concat_ws(chr(0), event_type, CAST(k AS VARCHAR))) AS key, arg_max(cents, event_id) AS cents FROM ev GROUP BY 1")
def _(t: Tables):
    c = t.ev.select(stage.content_key(F.col("event_type"), F.col("k")).alias("key"), "cents", "event_id")
    return stage.cache_latest(c, "key", "event_id").select("key", "cents")


@query("src20_cache_misses", f"WITH {EV} SELECT event_id FROM ev WHERE event_type = 'view' AND (user_id, k) NOT IN (SELECT user_id, k FROM ev WHERE event_type = 'click')")
def _(t: Tables):
    d = t.ev.withColumn("key", stage.content_key(F.col("user_id"), F.col("k")))
    return stage.cache_misses(d.filter("event_type = 'view'").select("event_id", "key"), d.filter("event_type = 'click'"), "key").select("event_id")


@query("src21_registry", """SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 10 = 0 THEN 'unregistered' WHEN doc_id % 10 = 1 THEN 'missing' WHEN doc_id % 10 = 2 THEN 'changed' ELSE 'ok' END AS status FROM documents""")
def _(t: Tables):
    """Registered document hashes against contents, some removed or altered."""
    d = t.documents.select(F.col("doc_id").cast("string").alias("path"), (F.col("doc_id") % 10).alias("m"), "text")
    reg = d.filter("m <> 0").select("path", F.sha2("text", 256).alias("sha256"))
    files = d.filter("m <> 1").select("path", F.when(F.col("m") == 2, F.concat("text", F.lit("!"))).otherwise(F.col("text")).cast("binary").alias("content"))
    return stage.verify_registry(files, reg)


@query("src22_split_guard", f"WITH {EV} SELECT k AS id, list_sort(list(DISTINCT sp)) AS splits FROM (SELECT k, CASE WHEN user_id < 3 THEN 'dev' ELSE 'train' END AS sp FROM ev) GROUP BY 1 HAVING count(DISTINCT sp) > 1")
def _(t: Tables):
    d = t.ev.select(F.col("k").alias("id"), "user_id")
    return quality.split_overlap({"dev": d.filter("user_id < 3"), "train": d.filter("user_id >= 3")}, ["id"])


@query("src23_dense_ids", f"""WITH {EV}, f AS (SELECT user_id, k, min(us) AS f FROM ev GROUP BY 1, 2) SELECT e.event_id, r.dense_id, CASE WHEN e.cents % 2 = 0 THEN e.k::DOUBLE END AS x_m FROM ev e
JOIN (SELECT user_id, k, row_number() OVER (PARTITION BY user_id ORDER BY f, k) AS dense_id FROM f) r ON r.user_id = e.user_id AND r.k = e.k""")
def _(t: Tables):
    """Track numbers by first appearance; geometry only in frames with an accepted calibration."""
    rows = t.ev.select("event_id", "user_id", F.col("us").alias("frame"), F.col("k").alias("track_id"), F.col("k").cast("double").alias("x_m"), F.lit(1.0).alias("y_m"))
    fm = t.ev.select("user_id", F.col("us").alias("frame"), F.col("event_id").alias("released"))
    cal = t.ev.select("user_id", F.col("us").alias("frame"), (F.col("cents") % 2 == 0).alias("accepted"))
    return labels.export_predictions(rows, fm, cal, ["user_id"]).select("event_id", "dense_id", "x_m")


@query("src24_reviewed", f"""WITH {EV}, tr AS (SELECT event_type AS label, us // {HOUR} AS frame, user_id AS track_id, k FROM ev), cov AS (SELECT DISTINCT us // {HOUR} AS frame, 'view' AS label FROM ev WHERE k < 50),
d AS (SELECT tr.*, count(*) OVER (PARTITION BY frame, track_id) AS n FROM tr JOIN cov USING (frame, label)) SELECT CASE WHEN n > 1 THEN 'duplicate_identity' WHEN k + 20 > 100 THEN 'box_outside_image' ELSE 'ok' END AS verdict, count(*) AS n FROM d GROUP BY 1""")
def _(t: Tables):
    hour = F.floor(F.col("us") / F.lit(HOUR))
    tr = t.ev.select(F.col("event_type").alias("label"), hour.alias("frame"), F.col("user_id").alias("track_id"), F.col("k").cast("double").alias("x1"), F.lit(0.0).alias("y1"), (F.col("k") + 20).cast("double").alias("x2"), F.lit(9.0).alias("y2"))
    cov = t.ev.filter("k < 50").select(hour.alias("frame"), F.lit("view").alias("label")).distinct()
    good, bad = labels.reviewed_annotations(tr, cov, 100.0, 10.0)
    return good.withColumn("verdict", F.lit("ok")).select("verdict").unionByName(bad.select(F.col("violation").alias("verdict"))).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query("src25_spadl_checks", f"""WITH {EV}, a AS (SELECT user_id AS game_id, k AS action_id, 1 + cents % 5 AS period_id, us, event_id FROM ev),
d AS (SELECT *, count(*) OVER (PARTITION BY game_id, action_id) AS n, lag(us) OVER (PARTITION BY game_id, period_id ORDER BY action_id, us) AS p FROM a)
SELECT event_id, CASE WHEN period_id > 4 THEN 'late_period' WHEN n > 1 THEN 'duplicate_key' WHEN us < p THEN 'clock_backwards' ELSE 'ok' END AS verdict FROM d""")
def _(t: Tables):
    a = t.ev.select(F.col("user_id").alias("game_id"), F.col("k").alias("action_id"), (F.lit(1) + F.col("cents") % 5).alias("period_id"), F.col("us").alias("time_seconds"), "event_id")
    return tracking.spadl_checked(a).select("event_id", "verdict")


@query("src26_window", f"""WITH {EV}, b AS (SELECT min(us) AS lo FROM ev), w AS (SELECT user_id % 20 AS game, us - lo AS t, k % 2 AS team, user_id AS player, event_id FROM ev, b WHERE us - lo >= {5 * DAY} AND us - lo < {20 * DAY})
SELECT event_id, t - {5 * DAY} AS t, dense_rank() OVER (PARTITION BY game ORDER BY team) - 1 AS team_no, dense_rank() OVER (PARTITION BY game ORDER BY player) - 1 AS track_no FROM w""")
def _(t: Tables):
    base = t.ev.agg(F.min("us").alias("lo"))
    d = t.ev.join(F.broadcast(base), F.lit(True)).select((F.col("user_id") % 20).alias("game"), (F.col("us") - F.col("lo")).alias("t"), F.col("event_id").alias("frame"), F.lit(1).alias("period"),  # one-row bound
                                                      (F.col("k") % 2).alias("team"), F.col("user_id").alias("player"), "event_id")
    return tracking.freeze_window(d, ["game"], "t", 5 * DAY, 20 * DAY).select("event_id", "t", "team_no", "track_no")


@query("src26_clock_step", f"WITH {EV}, d AS (SELECT user_id % 20 AS game, us - lag(us) OVER (PARTITION BY user_id % 20 ORDER BY us) AS d FROM ev) SELECT game, count(d) AS n, median(d)::DOUBLE AS step FROM d GROUP BY 1")
def _(t: Tables):
    return tracking.clock_step(t.ev.select((F.col("user_id") % 20).alias("game"), "us"), ["game"], "us")


@query("src27_harvest", f"""WITH {EV}, d AS (SELECT user_id, event_id AS frame, CASE WHEN event_type = 'click' THEN 'ball' ELSE 'person' END AS kind, k FROM ev), keep AS (SELECT * FROM d WHERE (kind='person' AND k >= 60) OR (kind='ball' AND k >= 45)),
b AS (SELECT user_id, frame, lead(frame) OVER (PARTITION BY user_id ORDER BY frame) - frame AS g FROM keep WHERE kind='ball'), f AS (SELECT user_id, frame + unnest(range(1, g)) AS frame FROM b WHERE g BETWEEN 2 AND 200),
all_ AS (SELECT user_id, kind, false AS filled, frame FROM keep UNION ALL SELECT user_id, 'ball', true, frame FROM f),
r AS (SELECT l.user_id, 'rim' AS kind, false AS filled, l.frame FROM (SELECT DISTINCT user_id, frame FROM all_) l JOIN ev ON ev.user_id = l.user_id AND event_type = 'purchase' AND l.frame BETWEEN event_id AND event_id + 300)
SELECT user_id, kind, filled, count(*) AS n, CAST(sum(frame) AS BIGINT) AS frames FROM (SELECT * FROM all_ UNION ALL SELECT * FROM r) GROUP BY 1, 2, 3""")
def _(t: Tables):
    k = F.col("k").cast("double")
    d = t.ev.select("user_id", F.col("event_id").alias("frame"), F.when(F.col("event_type") == "click", "ball").otherwise("person").alias("kind"), (F.col("k") / 100.0).alias("conf"), k.alias("x1"), k.alias("y1"), k.alias("x2"), k.alias("y2"))
    rims = t.ev.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("f0"), (F.col("event_id") + 300).alias("f1"), k.alias("x1"), k.alias("y1"), k.alias("x2"), k.alias("y2"))
    h = labels.harvest_labels(d, rims, ["user_id"], gap=(2, 200))
    return h.groupBy("user_id", "kind", "filled").agg(F.count(F.lit(1)).alias("n"), F.sum("frame").alias("frames"))


@query("src28_harvest_votes", f"""WITH {EV}, v AS (SELECT user_id AS e, min(k) AS number FROM ev WHERE event_type='signup' AND k <= 60 GROUP BY 1) SELECT event_id, number, r AS "rank" FROM
(SELECT event_id, CAST(v.number AS VARCHAR) AS number, row_number() OVER (PARTITION BY ev.user_id, event_type ORDER BY cents DESC, event_id) AS r FROM ev JOIN v ON v.e = ev.user_id) WHERE r <= 2""")
def _(t: Tables):
    v = t.ev.filter("event_type = 'signup' and k <= 60").groupBy(F.col("user_id").alias("entity_id")).agg(F.lpad(F.min("k").cast("string"), 2, "0").alias("number")).withColumn("job", F.lit(1))
    tr = t.ev.select(F.lit(1).alias("job"), F.concat_ws("-", "user_id", "event_type").alias("track_id"), F.col("user_id").alias("entity_id")).distinct()
    obs = t.ev.select(F.lit(1).alias("job"), F.concat_ws("-", "user_id", "event_type").alias("track_id"), F.col("event_id").alias("frame"), F.lit(0).alias("y1"), F.col("cents").alias("y2"))
    return labels.harvest_votes(v, tr, obs, ["job"], 2).select(F.col("frame").alias("event_id"), "number", "rank")


@query("src29_channel_census", f"""WITH {EV}, s AS (SELECT DISTINCT user_id, us // {DAY} AS d FROM ev), p AS (SELECT DISTINCT user_id, us // {DAY} AS d FROM ev WHERE event_type = 'purchase'),
g AS (SELECT s.user_id, count(*) AS expected, count(p.d) AS present FROM s LEFT JOIN p ON p.user_id = s.user_id AND p.d = s.d GROUP BY 1)
SELECT *, expected - present AS without, CASE WHEN present = 0 THEN 'empty' WHEN present < expected THEN 'partial' ELSE 'present' END AS status FROM g""")
def _(t: Tables):
    d = t.ev.withColumn("d", F.floor(F.col("us") / F.lit(DAY)))
    return quality.channel_census(d.select("user_id", "d"), d.filter("event_type = 'purchase'"), ["user_id", "d"], ["user_id"])


@query("agg47_hashed_tails", """WITH h AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY sha256(CAST(o_orderkey AS VARCHAR)), o_orderkey) AS r FROM orders QUALIFY r <= 6),
n AS (SELECT *, count(*) OVER (PARTITION BY o_custkey) - r AS back FROM h) SELECT o_custkey, o_orderkey, CASE WHEN back < 1 THEN 'test' WHEN back < 3 THEN 'dev' ELSE 'train' END AS split FROM n""")
def _(t: Tables):
    return splits.hashed_tail_split(t.orders.select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey", 6, 2, 1)


@query("agg47_chronological", f"""WITH {EV}, n AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY us) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM ev)
SELECT event_id, user_id, CASE WHEN r <= floor(n * 0.6::DOUBLE) THEN 'train' WHEN r <= floor(n * (0.6::DOUBLE + 0.2::DOUBLE)) THEN 'dev' ELSE 'test' END AS split FROM n""")
def _(t: Tables):
    return splits.chronological_split(t.ev.select("event_id", "user_id", "us"), ["user_id"], ["us"]).select("event_id", "user_id", "split")


@query("agg47_hash_percent", "SELECT doc_id FROM documents WHERE CAST('0x' || substr(sha1(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 < 15")
def _(t: Tables):
    return t.documents.filter(splits.is_validation(F.col("doc_id").cast("string"), 15)).select("doc_id")


@query("agg47_fill_by_size", """WITH g AS (SELECT c_nationkey, c_custkey, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2),
b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER (PARTITION BY c_nationkey) AS t FROM g)
SELECT c_nationkey, c_custkey, n, CASE WHEN before < t * 0.8 THEN 'train' ELSE 'valid' END AS split FROM b""")
def _(t: Tables):
    o = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    g = t.customer.join(o, F.col("c_custkey") == F.col("o_custkey")).select("c_nationkey", "c_custkey", "n")
    return splits.fill_by_size(g, ["c_nationkey"], "c_custkey", "n", 0.8)


@query("agg47_pinned", "SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) THEN 'valid' ELSE 'train' END AS split FROM documents")
def _(t: Tables):
    return splits.pinned_split(t.documents.select("doc_id"), t.labels.filter("quality = 0"), ["doc_id"])


@query("agg47_round_robin", f"""WITH {EV}, t AS (SELECT event_id, user_id, event_type, us, row_number() OVER (PARTITION BY user_id, event_type ORDER BY us) AS turn FROM ev)
SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY turn, event_type, us) AS pick FROM t QUALIFY pick <= 7""")
def _(t: Tables):
    return splits.round_robin(t.ev.select("event_id", "user_id", "event_type", "us"), ["user_id"], "event_type", ["us"], 7).select("event_id", "user_id", "pick")


@query("ord06_repeats", f"WITH {EV} SELECT event_id, unnest(range(1, k % 3 + 1)) AS copy FROM ev")
def _(t: Tables):
    d = labels.systematic_pool(t.ev.select("event_id", "k").filter("k % 3 > 0"), F.col("k") % 3)
    return d.select("event_id", F.col("copy").cast("long").alias("copy"))


@query("ord07_set_difference", """(SELECT doc_id, 'left' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) UNION ALL (SELECT doc_id, 'right' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents))""")
def _(t: Tables):
    return quality.symmetric_difference(t.documents, t.labels, ["doc_id"])


@query("ord08_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(t: Tables):
    return quality.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("dq01_row_rules", """SELECT 'discount_range' AS rule, count_if(NOT (l_discount BETWEEN 0 AND 0.08)) AS violations FROM lineitem UNION ALL SELECT 'positive_quantity', count_if(NOT l_quantity > 1) FROM lineitem UNION ALL SELECT 'flag_known', count_if(l_returnflag NOT IN ('A', 'N')) FROM lineitem""")
def _(t: Tables):
    return quality.count_violations(t.lineitem, {"discount_range": F.col("l_discount").between(0, 0.08), "positive_quantity": F.col("l_quantity") > 1, "flag_known": F.col("l_returnflag").isin("A", "N")})


@query("dq01_orphans", "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F') GROUP BY 1")
def _(t: Tables):
    o = quality.orphans(t.lineitem.select("l_orderkey"), t.orders.filter("o_orderstatus <> 'F'").select("o_orderkey"), {"l_orderkey": "o_orderkey"})
    return o.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("dq01_clock", f"WITH {EV}, d AS (SELECT event_id, user_id, k, lag(k) OVER (PARTITION BY user_id ORDER BY us) AS previous FROM ev) SELECT * FROM d WHERE k <= previous")
def _(t: Tables):
    return quality.clock_violations(t.ev.select("event_id", "user_id", "us", "k"), ["user_id"], ["us"], "k").drop("us")


@query("dq02_rule_status", f"""WITH {EV}, f AS (SELECT 'speed' AS rule, CASE WHEN event_type = 'error' THEN 'skipped' WHEN k > 98 THEN 'violation' ELSE 'checked' END AS outcome FROM ev UNION ALL SELECT 'identity', CASE WHEN cents < 0 THEN 'violation' ELSE 'checked' END FROM ev),
g AS (SELECT rule, count_if(outcome <> 'skipped') AS checked, count_if(outcome = 'skipped') AS skipped, count_if(outcome = 'violation') AS violations FROM f GROUP BY 1),
n AS (SELECT unnest(['speed', 'identity', 'ball']) AS rule)
SELECT n.rule, n.rule = 'speed' AS blocking, coalesce(checked, 0) AS checked, coalesce(skipped, 0) AS skipped, coalesce(violations, 0) AS violations,
  CASE WHEN violations > 0 THEN 'violations' WHEN coalesce(checked, 0) = 0 THEN 'skipped' WHEN skipped > 0 THEN 'partial' ELSE 'checked' END AS status, n.rule = 'speed' AND coalesce(violations, 0) > 0 AS blocks FROM n LEFT JOIN g ON g.rule = n.rule""")
def _(t: Tables):
    speed = F.when(F.col("event_type") == "error", "skipped").when(F.col("k") > 98, "violation").otherwise("checked")
    f = t.ev.select(F.lit("speed").alias("rule"), speed.alias("outcome")).unionByName(t.ev.select(F.lit("identity").alias("rule"), F.when(F.col("cents") < 0, "violation").otherwise("checked").alias("outcome")))
    return quality.rule_status(f, ["speed", "identity", "ball"], ["speed"])


@query("dq03_envelope", f"""WITH {EV}, m AS (SELECT DISTINCT user_id, us // {DAY} AS d FROM ev WHERE event_type IN ('view','click')), p AS (SELECT user_id, us // {DAY} AS d, count(*) AS n, count_if(k > 95) AS bad_scores FROM ev WHERE event_type IN ('click','purchase') GROUP BY 1, 2)
SELECT user_id, d, coalesce(n, 0) AS n, CASE WHEN m.d IS NULL THEN 'unexpected' WHEN bad_scores > 0 THEN 'bad_score' WHEN n IS NULL THEN 'missing' ELSE 'ok' END AS status FROM m FULL JOIN p USING (user_id, d)""".replace("m.d IS NULL", "m2 IS NULL").replace("SELECT DISTINCT user_id, us", "SELECT DISTINCT 1 AS m2, user_id, us"))
def _(t: Tables):
    d = t.ev.withColumn("d", F.floor(F.col("us") / F.lit(DAY)))
    m = d.filter("event_type in ('view', 'click')").select("user_id", "d").distinct()
    p = d.filter("event_type in ('click', 'purchase')").withColumn("score", F.col("k") / 95.0)
    return quality.envelope(m, p, ["user_id", "d"], "score").select("user_id", "d", "n", "status")


@query("dq04_reviews", f"""WITH {EV}, b AS (SELECT min(us) AS lo, max(us) AS hi FROM ev), r AS (SELECT event_id AS review_id, event_type AS field, k % 5 AS value, us AS s, us + (k - 5) * {HOUR} AS e, event_id + 1 AS evid FROM ev WHERE event_type IN ('view','error')),
j AS (SELECT r.*, x.us AS ev_at, lo, hi FROM r LEFT JOIN ev x ON x.event_id = r.evid, b)
SELECT review_id, 'unknown_field' AS violation FROM j WHERE field = 'error' UNION ALL SELECT review_id, 'value_outside_domain' FROM j WHERE field = 'view' AND value > 3 UNION ALL SELECT review_id, 'empty_interval' FROM j WHERE NOT s < e
UNION ALL SELECT review_id, 'unknown_evidence' FROM j WHERE ev_at IS NULL UNION ALL SELECT review_id, 'evidence_outside_interval' FROM j WHERE ev_at IS NOT NULL AND NOT (ev_at >= s AND ev_at < e)""")
def _(t: Tables):
    r = t.ev.filter("event_type in ('view', 'error')").select(F.col("event_id").alias("review_id"), F.col("event_type").alias("field"), (F.col("k") % 5).cast("string").alias("value"), F.col("us").alias("start"),
                                                             (F.col("us") + (F.col("k") - 5) * HOUR).alias("end"), (F.col("event_id") + 1).alias("evidence_id"))
    e = t.ev.select(F.col("event_id").alias("evidence_id"), F.col("us").alias("at"))
    return quality.review_violations(r, e, {"view": ["0", "1", "2", "3"]}, (0, 1 << 62))


@query("agg48_acceptance", f"""WITH {EV}, m AS (SELECT event_type AS path, count(*)::DOUBLE AS value FROM ev GROUP BY 1), c AS (SELECT 'view' AS path, '>=' AS op, 10.0::DOUBLE AS threshold UNION ALL SELECT 'click', '<=', 10.0 UNION ALL SELECT 'goal', '>', 0.0)
SELECT c.path, op, threshold, CASE WHEN value IS NULL THEN 'unmeasured' WHEN (op = '>=' AND value >= threshold) OR (op = '<=' AND value <= threshold) OR (op = '>' AND value > threshold) THEN 'accepted' ELSE 'rejected' END AS verdict FROM c LEFT JOIN m ON m.path = c.path""")
def _(t: Tables):
    m = t.ev.groupBy(F.col("event_type").alias("path")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    c = t.spark.createDataFrame([("view", ">=", 10.0), ("click", "<=", 10.0), ("goal", ">", 0.0)], "path string, op string, threshold double")
    return quality.acceptance(m, c).drop("value")
