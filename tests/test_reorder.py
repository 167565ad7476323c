"""Unordered streams: the result does not depend on files, triggers, restarts or replays."""

import random

import pytest
from pyspark.sql import functions as F

from fieldtrace.operators import folds
from fieldtrace.streaming import reorder, rules, stateful

SCHEMA = "p int, us bigint, event_id bigint, label string, ts timestamp"
SPANS = "label string, start bigint, end bigint, n bigint"
S = 1_000_000


def write(spark, path, parts):
    for part in parts:
        d = spark.createDataFrame(part, "p int, us bigint, event_id bigint, label string")
        d.withColumn("ts", F.timestamp_micros("us")).coalesce(1).write.mode("append").parquet(path)


@pytest.fixture(scope="module")
def events():
    rng = random.Random(6)
    out, clock = [], {1: 0, 2: 500}
    for i in range(160):
        p = rng.choice([1, 2])
        clock[p] += rng.choice([0, S, S, 2 * S, 31 * S] if rng.random() < 0.3 else [S])
        out.append((p, clock[p], i, rng.choice("aab")))
    return sorted(out, key=lambda r: r[1])


def spans(events, idle_us):
    """What the rule gives per key in order of time, with a break where a key pauses longer than ``idle_us``."""
    out, rule = [], rules.run_rule("us", "label", 10 * S)
    for p in (1, 2):
        state, last = None, None
        for _, us, i, label in sorted((e for e in events if e[0] == p), key=lambda e: (e[1], e[2])):
            if last is not None and us - last > idle_us:
                out += [(p, *r.values()) for r in rule.close(state)]
                state = None
            state, emitted = rule.step(state, {"us": us, "label": label})
            out += [(p, *r.values()) for r in emitted]
            last = us
        out += [(p, *r.values()) for r in rule.close(state)]
    return sorted(out)


def streamed(spark, src, most, where, cp=None):
    live = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", most).parquet(src)
    s = reorder.ordered_stream(live, ["p"], "ts", ["us", "event_id"], rules.run_rule("us", "label", 10 * S), SPANS, "40 seconds", 20_000)
    d = stateful.drain(s, where, checkpoint=cp)
    return sorted(tuple(r) for r in d.select("p", "label", "start", "end", "n").collect())


def test_one_result_for_every_cut(spark, tmp_path, events):
    rng = random.Random(1)
    far = max(e[1] for e in events) + 1000 * S  # moves the watermark past all rows; its own span stays open
    late = sorted(events, key=lambda e: e[1] + rng.randrange(35 * S))  # out of order by less than the delay
    want = spans(events, 20 * S)
    for name, most, parts in (("all", 100, [late, [(9, far, 999, "z")]]), ("each", 1, [late[k:k + 20] for k in range(0, len(late), 20)] + [[(9, far, 999, "z")]])):
        src = str(tmp_path / name)
        write(spark, src, parts)
        got = streamed(spark, src, most, str(tmp_path / f"out-{name}"))
        assert [r for r in got if r[0] != 9] == want and len(want) > 20


def test_restart_goes_on_where_it_stopped(spark, tmp_path, events):
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    far = max(e[1] for e in events) + 1000 * S
    write(spark, src, [events[:70]])
    streamed(spark, src, 10, out, cp)
    write(spark, src, [events[70:], [(9, far, 999, "z")]])
    assert [r for r in streamed(spark, src, 10, out, cp) if r[0] != 9] == spans(events, 20 * S)


def test_replayed_batches_write_once(spark, tmp_path):
    log = str(tmp_path / "log")
    a = spark.createDataFrame([("r", "k1", 1, "a"), ("r", "k1", 2, "b")], "run string, source_key string, seq int, payload string")
    b = spark.createDataFrame([("r", "k2", 3, "c"), ("r", "k1", 1, "a"), ("r", "k1", 2, "b")], a.schema)
    read = lambda: sorted((r["source_key"], r["seq"], r["revision"]) for r in spark.read.parquet(log).collect())
    for _ in range(2):  # the second is the same batch again, after a failure behind the write
        stateful.append_revisions(a, log, name="s-0")
        assert read() == [("k1", 1, 1), ("k1", 2, 2)]
    for _ in range(2):
        stateful.append_revisions(b, log, name="s-1")
        assert read() == [("k1", 1, 1), ("k1", 2, 2), ("k2", 3, 3)]
    with pytest.raises(ValueError, match="used before"):
        stateful.append_revisions(b.withColumn("payload", F.lit("z")), log, name="s-2")


def test_work_runs_once_for_a_replayed_batch(spark, tmp_path):
    done, parked = str(tmp_path / "done"), str(tmp_path / "parked")
    jobs = spark.createDataFrame([(i,) for i in range(6)], "job int")
    work = lambda d: d.select("job", (F.col("job") % 3 > 0).alias("ok"), F.lit("n").alias("note"))
    for _ in range(2):
        stateful.work_batch(jobs, "s-0", done, parked, work, ["job"])
    stateful.work_batch(jobs.filter("job < 3").unionByName(spark.createDataFrame([(7,)], "job int")), "s-1", done, parked, work, ["job"])
    assert sorted(r["job"] for r in spark.read.parquet(done).collect()) == [1, 2, 4, 5, 7]
    assert sorted(r["job"] for r in spark.read.parquet(parked).collect()) == [0, 3]
