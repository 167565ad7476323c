"""Play-by-play documents, image-label corpora, result documents, exports and harvest tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtrace.operators.ordered import next_, row_number, scan, top_k

PBP = ("header struct<id:string,competitions:array<struct<id:string,date:string,competitors:array<struct<team:struct<location:string,displayName:string,nickname:string,abbreviation:string>>>>>>, "
       "plays array<struct<id:string,sequenceNumber:string,period:struct<number:int>,clock:struct<displayValue:string>,type:struct<text:string>,text:string,shootingPlay:boolean,scoringPlay:boolean,scoreValue:int,"
       "participants:array<struct<athlete:struct<id:string>>>,coordinate:struct<x:double,y:double>>>, "
       "boxscore struct<players:array<struct<statistics:array<struct<athletes:array<struct<athlete:struct<id:string,jersey:string>>>>>>>>")


def pbp_documents(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """SRC-12 / SRC-13: one row per readable summary; broken files are dropped."""
    return spark.read.schema(PBP).option("multiLine", multi_line).option("mode", "DROPMALFORMED").json(path).withColumn("path", F.input_file_name())


def pbp_plays(docs: DataFrame) -> DataFrame:
    """SRC-12: plays with the athletes and the first athlete's jersey (the last listing of an athlete wins)."""
    from fieldtrace.functions.text import parse_clock

    at = docs.select("path", F.posexplode_outer("boxscore.players").alias("i", "p")).select("path", "i", F.posexplode("p.statistics").alias("j", "s")).select("path", "i", "j", F.posexplode("s.athletes").alias("k", "a"))
    # one document per path and header id
    jersey = at.groupBy("path", F.col("a.athlete.id").alias("athlete")).agg(F.max_by("a.athlete.jersey", F.struct("i", "j", "k")).alias("shooter_jersey"))
    p = docs.select("path", F.posexplode("plays").alias("sequence", "p")).select(
        "path", F.col("p.id").alias("play_id"), "sequence", F.col("p.period.number").alias("period"), parse_clock(F.col("p.clock.displayValue")).alias("clock_s"), F.col("p.type.text").alias("type_text"),
        F.col("p.text").alias("text"), F.coalesce("p.shootingPlay", F.lit(False)).alias("shooting_play"), F.coalesce("p.scoringPlay", F.lit(False)).alias("scoring_play"), F.coalesce("p.scoreValue", F.lit(0)).alias("score_value"),
        F.transform(F.coalesce("p.participants", F.array().cast("array<struct<athlete:struct<id:string>>>")), lambda x: x["athlete"]["id"]).alias("athlete_ids"),
        F.col("p.coordinate.x").alias("coord_x"), F.col("p.coordinate.y").alias("coord_y"))
    return p.withColumn("athlete", F.get("athlete_ids", F.lit(0))).join(jersey, ["path", "athlete"], "left").drop("athlete")


def corpus_index(docs: DataFrame) -> DataFrame:
    """SRC-13: event id, day, the two locations and their alternative names."""
    c = docs.select("path", F.get("header.competitions", F.lit(0)).alias("c"))
    team = lambda t: F.array_distinct(F.array_compact(F.array(t["location"], t["displayName"], t["nickname"], t["abbreviation"])))
    d = c.select("path", F.col("c.id").alias("event_id"), F.date_format(F.try_to_timestamp(F.substring("c.date", 1, 10), F.lit("yyyy-MM-dd")), "yyyyMMdd").alias("date"),
                 F.transform("c.competitors", lambda x: x["team"]["location"]).alias("locs"), F.transform("c.competitors", lambda x: team(x["team"])).alias("names"))
    return d.filter(F.size(F.array_distinct(F.array_compact("locs"))) == 2)


def merge_coco(sources: dict[str, tuple[DataFrame, DataFrame, dict[str, str]]]) -> tuple[DataFrame, DataFrame]:
    """SRC-14: union of label sets with mapped class names; images without a mapped box go; new dense ids.

    Each source is (images: split, image_id, file_name; boxes: split, image_id, category, x, y, w, h; name map).
    The split "test" joins "train". Ids come from an order over (source, split, image).
    """
    im_parts, box_parts = [], []
    for name, (images, boxes, names) in sorted(sources.items()):
        m = F.create_map(*[F.lit(v) for kv in names.items() for v in kv])
        split = F.when(F.col("split") == "test", "train").otherwise(F.col("split")).alias("split")
        b = boxes.select(F.lit(name).alias("source"), F.col("split").alias("_s"), F.col("image_id").alias("_i"), F.try_element_at(m, F.col("category")).alias("category"), "x", "y", "w", "h").filter("category is not null")
        im = images.select(F.lit(name).alias("source"), F.col("split").alias("_s"), F.col("image_id").alias("_i"), split, "file_name").join(b.select("source", "_s", "_i").distinct(), ["source", "_s", "_i"], "left_semi")
        im_parts.append(im)
        box_parts.append(b)
    im = _dense(reduce(DataFrame.unionByName, im_parts), ["source", "_s", "_i"], "image_no")
    bx = reduce(DataFrame.unionByName, box_parts).join(im.select("source", "_s", "_i", "image_no", "split"), ["source", "_s", "_i"])
    bx = _dense(bx, ["image_no", "category", "x", "y", "w", "h"], "box_no")
    return im.drop("_s", "_i"), bx.drop("_s", "_i")


def _dense(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Dense ids 1..n over a whole table without one global sort task: numbers inside hash-free range
    slices of the order plus the sizes of the slices before."""
    part = df.repartitionByRange(*order).sortWithinPartitions(*order)
    from fieldtrace.session import cut_lineage
    fixed = cut_lineage(part.withColumn("_part", F.spark_partition_id()).withColumn("_pos", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    sizes = fixed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    w = scan(sizes.withColumn("_k", F.lit(0)).withColumn("_part", F.col("_part").cast("long")), ["_k"], ["_part"], {"_c": _cum()}).select("_part", (F.col("_c") - F.col("_n")).alias("_base"))
    return fixed.join(F.broadcast(w), "_part").withColumn(out, F.col("_base") + F.col("_pos") + 1).drop("_part", "_pos", "_base")  # one row per partition


def _cum():
    from fieldtrace.operators.ordered import running_sum
    return running_sum(F.col("_n"))


def export_splits(splits: dict[str, DataFrame], stem: str) -> tuple[DataFrame, DataFrame]:
    """SRC-15: union of export splits and the stems found in more than one."""
    d = reduce(DataFrame.unionByName, [df.withColumn("split", F.lit(n)) for n, df in splits.items()])
    leak = d.groupBy(stem).agg(F.array_sort(F.collect_set("split")).alias("splits")).filter(F.size("splits") > 1)
    return d, leak


def result_documents(box: DataFrame, events: DataFrame) -> DataFrame:
    """SRC-16: one JSON document per job: totals, lines and events; the unattributed line stays a line, so
    the totals add up. A job has a roster's worth of lines and a game's worth of credited events.
    """
    stats = [c for c in box.columns if c not in ("job_id", "team", "player_key", "entity_id", "confidence")]
    total = box.groupBy("job_id").agg(F.struct(*[F.sum(c).alias(c) for c in stats]).alias("totals"))
    lines = box.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("team", "player_key", *stats))).alias("players"))
    ev = events.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct(*[c for c in events.columns if c != "job_id"]))).alias("events"))
    d = total.join(lines, "job_id").join(ev, "job_id", "left")
    return d.select("job_id", F.to_json(F.struct("totals", "players", F.coalesce("events", F.array().cast(ev.schema["events"].dataType)).alias("events"))).alias("document"))


def results_to_shots(events: DataFrame) -> DataFrame:
    """SRC-17: attempts of a result document with their outcome: the next outcome of the same team and
    player before that player's next attempt."""
    from fieldtrace.operators.asof import pair_outcomes
    d = pair_outcomes(events, ["job_id", "team", "player"], ["ts_ms", "seq"], F.col("kind") == "attempt", F.col("kind") == "made", {"made_ts": "ts_ms"})
    return d.withColumn("made", F.col("made_ts").isNotNull())


def entity_keyframes(boxes: DataFrame, entities: DataFrame, keys: list[str], entity: str, t: str, gap: int, hot_rows: int | None = None) -> DataFrame:
    """SRC-18: keyframes at least ``gap`` apart for the listed entities, one row each (nest at the sink)."""
    from fieldtrace.operators.folds import min_gap_sample
    wanted = boxes.join(entities.select(*keys, entity).distinct(), [*keys, entity], "left_semi")
    return min_gap_sample(wanted, [*keys, entity], [t], gap, hot_rows=hot_rows)


def keyframe_documents(frames: DataFrame, keys: list[str], entity: str, columns: list[str]) -> DataFrame:
    """SRC-18 sink: per key the JSON document {entity: [[...], ...]} of its keyframes, in order of the first column.

    A document is one match; its keyframes are thinned by ``gap`` before, so it stays as long as the match.
    """
    row = F.array(*[F.col(c).cast("double") for c in columns])
    lists = frames.groupBy(*keys, entity).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(columns[0]), row.alias("r")))), lambda x: x["r"]).alias("_f"))
    entries = F.array_sort(F.collect_list(F.struct(F.col(entity).cast("string").alias("k"), F.col("_f").alias("v"))))
    return lists.groupBy(*keys).agg(F.to_json(F.map_from_entries(entries)).alias("document"))


def dense_by_appearance(rows: DataFrame, keys: list[str], ident: str, order: list[str], out: str, hot_rows: int | None = None) -> DataFrame:
    """SRC-23: dense ids by first appearance inside each key."""
    first = rows.groupBy(*keys, ident).agg(F.min(F.struct(*order)).alias("_f")).select(*keys, ident, *[F.col(f"_f.{c}").alias(f"_{c}") for c in order])
    num = scan(first, keys, [f"_{c}" for c in order], {out: row_number()}, hot_rows).select(*keys, ident, F.col(out))
    return rows.join(num, [*keys, ident])


def export_predictions(rows: DataFrame, frame_map: DataFrame, calibration: DataFrame, keys: list[str], hot_rows: int | None = None) -> DataFrame:
    """SRC-23: predictions on the released frame numbers; pitch points only where the calibration was accepted."""
    d = dense_by_appearance(rows, keys, "track_id", ["frame", "track_id"], "dense_id", hot_rows)
    d = d.join(frame_map, [*keys, "frame"]).join(calibration.select(*keys, "frame", "accepted"), [*keys, "frame"], "left")
    ok = F.coalesce("accepted", F.lit(False))
    return d.withColumn("x_m", F.when(ok, F.col("x_m"))).withColumn("y_m", F.when(ok, F.col("y_m"))).drop("accepted")


CVAT = ("_id bigint, _label string, box array<struct<_frame:int,_outside:int,_keyframe:int,_xtl:double,_ytl:double,_xbr:double,_ybr:double>>")


def cvat_tracks(spark: SparkSession, path: str) -> DataFrame:
    """SRC-24: tracks of a reviewed-annotation XML, one row per visible explicit keyframe."""
    d = spark.read.format("xml").option("rowTag", "track").schema(CVAT).load(path)
    b = d.select(F.col("_id").alias("track_id"), F.col("_label").alias("label"), F.explode("box").alias("b"))
    return b.filter("b._keyframe = 1 and b._outside = 0").select("track_id", "label", F.col("b._frame").alias("frame"), F.col("b._xtl").alias("x1"), F.col("b._ytl").alias("y1"), F.col("b._xbr").alias("x2"), F.col("b._ybr").alias("y2"))


def reviewed_annotations(tracks: DataFrame, coverage: DataFrame, width: float, height: float) -> tuple[DataFrame, DataFrame]:
    """SRC-24: boxes of the (frame, label) pairs declared exhaustive, and the violations among them."""
    d = tracks.join(coverage.select("frame", "label").distinct(), ["frame", "label"], "left_semi")
    n = d.groupBy("frame", "track_id").agg(F.count(F.lit(1)).alias("_n"))
    d = d.join(n, ["frame", "track_id"])
    inside = (F.col("x1") >= 0) & (F.col("y1") >= 0) & (F.col("x2") <= width) & (F.col("y2") <= height) & (F.col("x1") < F.col("x2")) & (F.col("y1") < F.col("y2"))
    bad = d.withColumn("violation", F.when(F.col("_n") > 1, "duplicate_identity").when(~inside, "box_outside_image")).filter("violation is not null").drop("_n")
    return d.filter((F.col("_n") == 1) & inside).drop("_n"), bad


def harvest_labels(det: DataFrame, rims: DataFrame, keys: list[str], person: float = 0.6, ball: float = 0.45, gap: tuple[int, int] = (2, 6), hot_rows: int | None = None) -> DataFrame:
    """SRC-27: confident people and balls, balls filled across short gaps (flagged), and the validated
    reference boxes of the segment on every labelled frame. ``det``: keys, frame, kind, conf, x1..y2;
    ``rims``: keys, f0, f1, x1..y2."""
    cols = ["x1", "y1", "x2", "y2"]
    keep = det.filter(((F.col("kind") == "person") & (F.col("conf") >= person)) | ((F.col("kind") == "ball") & (F.col("conf") >= ball)))
    base = keep.select(*keys, F.col("frame").cast("long").alias("frame"), "kind", *[F.col(c).cast("double").alias(c) for c in cols], F.lit(False).alias("filled"))
    one = base.filter("kind = 'ball'").groupBy(*keys, "frame").agg(F.min_by(F.struct(*cols), F.struct(*cols)).alias("b")).select(*keys, "frame", "b.*")
    b = scan(one, keys, ["frame"], {"_n": next_(F.struct("frame", *cols))}, hot_rows).withColumn("_g", F.col("_n.frame") - F.col("frame")).filter(F.col("_g").between(*gap))
    b = b.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_g") - 1)))
    share = F.col("_i") / F.col("_g")
    fill = b.select(*keys, (F.col("frame") + F.col("_i")).alias("frame"), F.lit("ball").alias("kind"), *[(F.col(c) + (F.col(f"_n.{c}") - F.col(c)) * share).alias(c) for c in cols], F.lit(True).alias("filled"))
    rows = base.unionByName(fill)
    labelled = rows.select(*keys, "frame").distinct()
    from fieldtrace.operators.interval import span_pairs
    r = span_pairs(labelled, rims.select(*keys, "f0", "f1", *cols), keys, "frame", "f0", "f1", 1024)
    return rows.unionByName(r.select(*keys, "frame", F.lit("rim").alias("kind"), *[F.col(c).cast("double").alias(c) for c in cols], F.lit(False).alias("filled")))


def harvest_votes(votes: DataFrame, tracks: DataFrame, obs: DataFrame, keys: list[str], k: int) -> DataFrame:
    """SRC-28: tallest ``k`` boxes of each track whose entity has a confirmed, normalisable number."""
    from fieldtrace.functions.text import normalize_number
    v = votes.withColumn("number", normalize_number(F.col("number"))).filter("number is not null")
    d = obs.join(tracks.join(v, [*keys, "entity_id"]), [*keys, "track_id"])
    return top_k(d, [*keys, "track_id"], [(F.col("y2") - F.col("y1")).desc(), F.col("frame")], k)


def systematic_pool(rows: DataFrame, repeats: Column) -> DataFrame:
    """ORD-06: each row as often as it says."""
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), repeats.cast("int")))).filter(repeats > 0)
