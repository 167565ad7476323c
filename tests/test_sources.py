"""Provider files, stages and stream sinks on small literal files."""

import json

import pytest
from pyspark.sql import functions as F

from conftest import rows
from fieldtrace.operators import folds
from fieldtrace.plans import pitch
from fieldtrace.schemas import stage_schema
from fieldtrace.sources import labels, stage, tracking
from fieldtrace.streaming import rules, stateful


def test_stage_contract(spark, tmp_path):
    path = str(tmp_path / "s")
    with pytest.raises(FileNotFoundError):
        stage.read_stage(spark, path)
    empty = spark.createDataFrame([], stage_schema("possessions"))
    stage.write_stage(empty, path, stage_schema("possessions"))
    assert stage.read_stage(spark, path, stage_schema("possessions")).count() == 0
    (tmp_path / "s" / "_SUCCESS").unlink()
    with pytest.raises(FileNotFoundError):
        stage.read_stage(spark, path)


def metrica_csv(path, team, ball_x="0.5", t2="0.24"):
    lines = [f",,,{team},,{team},,,", ",,,11,,1,,,", "Period,Frame,Time [s],Player11,,Player1,,Ball,"]
    x = "0.2" if team == "Home" else "0.8"
    for i, t in enumerate(["0.04", "0.08", t2, "0.44"]):
        lines.append(f"1,{i + 1},{t},{x},0.5,{'NaN' if i == 2 else x},0.25,{ball_x},0.5")
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_metrica_files(spark, tmp_path):
    h = tracking.metrica_tracking(spark, metrica_csv(tmp_path / "h.csv", "Home"), 0)
    a = tracking.metrica_tracking(spark, metrica_csv(tmp_path / "a.csv", "Away"), 1)
    # 0.04 and 0.08 share a fifth of a second
    assert rows(h.select("frame").distinct()) == [(1,), (3,), (4,)]
    g = tracking.metrica_game(h, a)
    assert g.filter("player = 'ball'").count() == 3 and g.filter("player = 'Home:Player11' and x_m = 21.0").count() == 3
    assert g.filter("x_m is null").count() == 2
    d = pitch.direction_by_period(g.withColumn("game", F.lit(1)))
    assert rows(d.select("team", "direction")) == [(0, 1), (1, -1)]
    o = tracking.provider_observations(g.withColumn("game", F.lit(1)), ["game"])
    assert o.count() == 15 and o.filter("status = 'unavailable'").count() == 2
    other = tracking.metrica_tracking(spark, metrica_csv(tmp_path / "b.csv", "Away", ball_x="0.6"), 1)
    with pytest.raises(Exception, match="ball disagree"):
        tracking.metrica_game(h, other).collect()
    late = tracking.metrica_tracking(spark, metrica_csv(tmp_path / "c.csv", "Away", t2="0.26"), 1)
    with pytest.raises(Exception, match="clocks disagree"):
        tracking.metrica_game(h, late).collect()


def test_gsr_labels(spark, tmp_path):
    doc = {"info": {"frame_rate": 25.0}, "images": [{"image_id": "a", "file_name": "000026.jpg", "has_labeled_person": True, "has_labeled_pitch": True, "has_labeled_camera": False}],
           "annotations": [{"id": "1", "image_id": "a", "track_id": 3, "supercategory": "object", "category_id": 1, "bbox_image": {"x": 1, "y": 2, "w": 3, "h": 4}},
                           {"id": "2", "image_id": "a", "track_id": 3, "supercategory": "pitch", "category_id": 5}]}
    p = tmp_path / "Labels-GameState.json"
    p.write_text(json.dumps(doc))
    frames, objects = tracking.gsr_labels(spark, str(p))
    assert rows(frames.select("frame", "timestamp_s", "scored")) == [(26, 1.0, False)]
    assert rows(objects.select("frame", "track_id", "x2", "y2")) == [(26, 3, 4.0, 6.0)]
    doc["annotations"][0]["image_id"] = "missing"
    p.write_text(json.dumps(doc))
    with pytest.raises(Exception, match="without an image"):
        tracking.gsr_labels(spark, str(p))[1].collect()


def test_reviewed_xml(spark, tmp_path):
    p = tmp_path / "a.xml"
    p.write_text('<annotations><track id="1" label="player"><box frame="0" keyframe="1" outside="0" xtl="1" ytl="1" xbr="5" ybr="9"/><box frame="1" keyframe="0" outside="0" xtl="1" ytl="1" xbr="5" ybr="9"/>'
                 '<box frame="2" keyframe="1" outside="0" xtl="-1" ytl="1" xbr="5" ybr="9"/></track></annotations>')
    t = labels.cvat_tracks(spark, str(p))
    assert rows(t.select("frame")) == [(0,), (2,)]
    cov = spark.createDataFrame([(0, "player"), (2, "player")], "frame int, label string")
    good, bad = labels.reviewed_annotations(t, cov, 100, 100)
    assert rows(good.select("frame")) == [(0,)] and rows(bad.select("frame", "violation")) == [(2, "box_outside_image")]


def test_mot_truth_is_unique(spark):
    raw = spark.createDataFrame([("s", "1", "4", "0", "0", "5", "6", "1"), ("s", "1", "5", "0", "0", "0", "6", "1"), ("s", "1", "6", "0", "0", "5", "6", "0")], "seq string, " + ", ".join(f"c{i} string" for i in range(7)))
    assert rows(tracking.mot_rows(raw, True, ["seq"]).select("track_id", "x2", "y2")) == [(4, 5.0, 6.0)]
    with pytest.raises(Exception, match="twice"):
        tracking.mot_rows(raw.unionByName(raw), True, ["seq"]).collect()


def test_registry_and_cache(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"x")
    files = spark.read.format("binaryFile").load(str(tmp_path / "a.bin"))
    path = files.first()["path"]
    import hashlib
    reg = spark.createDataFrame([(path, hashlib.sha256(b"x").hexdigest()), ("gone", "0")], "path string, sha256 string")
    assert {r["status"] for r in stage.verify_registry(files, reg).collect()} == {"ok", "missing"}
    c = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new")], "key string, seq int, value string")
    assert stage.cache_latest(c, "key", "seq").first()["value"] == "new"


def test_revisions_are_idempotent(spark, tmp_path):
    log = str(tmp_path / "log")
    b = spark.createDataFrame([("r", "k1", 1, "a"), ("r", "k1", 2, "b")], "run string, source_key string, seq int, payload string")
    stateful.append_revisions(b, log)
    stateful.append_revisions(b, log)
    assert rows(spark.read.parquet(log).select("seq", "revision")) == [(1, 1), (2, 2)]
    with pytest.raises(ValueError, match="used before"):
        stateful.append_revisions(b.withColumn("payload", F.lit("z")), log)
    more = spark.createDataFrame([("r", "k2", 3, "c")], b.schema)
    with pytest.raises(ValueError, match="newer"):
        stateful.append_revisions(more, log, expected=1)
    stateful.append_revisions(more, log, expected=2)
    assert spark.read.parquet(log).agg(F.max("revision")).first()[0] == 3


def test_triggers_may_cut_a_tie(spark, tmp_path):
    """The same votes whether one trigger or four bring rows of one clock."""
    ddl, got = "event_id bigint, hypothesis string, status string", []
    for most in (100, 1):
        src = str(tmp_path / f"src{most}")
        for i, (us, event) in enumerate([(1, 1), (5, 2), (5, 3), (9, 4)]):
            spark.createDataFrame([(1, us, event, us, "a")], "p int, us bigint, event_id bigint, d bigint, label string").coalesce(1).write.mode("append").parquet(src)
            if i == 0:
                schema = spark.read.parquet(src).schema
        live = spark.readStream.schema(schema).option("maxFilesPerTrigger", most).parquet(src)
        out = stateful.drain(stateful.stream_fold(live, ["p"], ["us", "event_id"], rules.consensus_rule("d", "label"), ddl), str(tmp_path / f"out{most}"))
        got.append(rows(out))
    assert got[0] == got[1] and len(got[0]) == 4 and all(r[-1] == 0 for r in got[0])


def test_stream_equals_batch_and_counts_late_rows(spark, tmp_path):
    src = str(tmp_path / "in")
    d = spark.createDataFrame([(1, t, i, float(t), 1.0) for i, t in enumerate((0, 1, 2, 9))] + [(2, 1, 9, None, None)], "p int, t int, event_id int, x double, y double")
    ddl = "event_id bigint, status string, held_x double, held_y double, moving_x double, moving_y double, age double"
    rule = rules.last_seen_rule(3.0, 1.5)
    d.write.parquet(src)
    s = stateful.stream_fold(spark.readStream.schema(d.schema).parquet(src), ["p"], ["t"], rule, ddl)
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    first = stateful.drain(s, out, checkpoint=cp)
    assert rows(first.drop("late_rows")) == rows(folds.fold(d, ["p"], ["t"], rule, ddl))
    # a second file with one late and one new row
    spark.createDataFrame([(1, 3, 20, 5.0, 5.0), (1, 11, 21, None, None)], d.schema).write.mode("append").parquet(src)
    again = stateful.drain(s, out, checkpoint=cp)
    assert rows(again.filter("event_id >= 20").select("event_id", "status", "late_rows")) == [(21, "estimated", 1)]


def test_last_seen_state(spark):
    d = spark.createDataFrame([(1, 0.0, 1, 10.0, 10.0), (1, 0.4, 2, 12.0, 10.0), (1, 1.4, 3, None, None), (1, 9.0, 4, None, None)], "p int, t double, event_id int, x double, y double")
    got = folds.fold(d, ["p"], ["t"], rules.last_seen_rule(), "event_id bigint, status string, held_x double, held_y double, moving_x double, moving_y double, age double")
    r = {x["event_id"]: x for x in got.collect()}
    assert [r[i]["status"] for i in (1, 2, 3, 4)] == ["observed", "observed", "estimated", "unavailable"]
    assert abs(r[3]["moving_x"] - 17.0) < 1e-9 and r[3]["held_x"] == 12.0


def test_confirmed_object_and_camera(spark):
    c = lambda x: [(x, 0.0, 0.9)]
    d = spark.createDataFrame([(1, 0.0, c(0.0)), (1, 0.1, c(1.0)), (1, 0.2, []), (1, 1.5, c(500.0))], "p int, t double, candidates array<struct<x:double,y:double,score:double>>")
    got = folds.fold(d, ["p"], ["t"], rules.ball_rule(1000.0), "t double, status string, x double, y double, selected bigint, age double")
    assert [r["status"] for r in got.orderBy("t").collect()] == ["tentative", "detected", "estimated", "tentative"]
    feet = [(float(x), float(y)) for x in (0, 50, 100) for y in (0, 40)]
    h = lambda dx: [0.1, 0.0, dx, 0.0, 0.1, 0.0, 0.0, 0.0, 1.0]
    shifts = [0.0, 0.1, 40.0, 40.0, 40.0]
    d = spark.createDataFrame([(1, float(i), True, None, h(dx), feet) for i, dx in enumerate(shifts)] + [(1, 9.0, False, "no_lines", None, feet)],
                              "p int, t double, accepted boolean, reason string, h array<double>, feet array<struct<x:double,y:double>>")
    got = folds.fold(rules.camera_faults(d).drop("accepted", "reason"), ["p"], ["t"], rules.camera_rule(rules.CameraLimits(jump=3.0)), "t double, accepted boolean, reason string").orderBy("t").collect()
    assert [r["accepted"] for r in got] == [True, True, False, False, True, False] and got[-1]["reason"] == "no_lines"


def test_keyframe_document(spark):
    d = spark.createDataFrame([("g", 2, 5, 1.5), ("g", 1, 9, 3.0), ("g", 2, 1, 0.5)], "game string, entity int, t int, x double")
    assert labels.keyframe_documents(d, ["game"], "entity", ["t", "x"]).first()["document"] == '{"1":[[9.0,3.0]],"2":[[1.0,0.5],[5.0,1.5]]}'
