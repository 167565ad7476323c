"""Rules of :mod:`fieldtrace.operators.folds` as stateful streams.

The same step function drives the batch fold and the stream. A key's state is the rule's JSON state, the full
position (all order columns) of its last row, and the number of late rows. Rows before that position are counted and
dropped; rows at the same position are ties and go on, so that it does not matter how triggers cut a tie.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fieldtrace.operators.folds import Rule, _dump, _missing


def stream_fold(df: DataFrame, keys: list[str], order: list[str], rule: Rule, out: str) -> DataFrame:
    """Rows emitted by ``rule`` per key, with ``late_rows`` dropped so far. ``order[0]`` is the clock; ties are
    ordered by the rest of ``order``.

    A trigger's rows of one key are sorted in memory: bound them with the source's rate limit.
    """
    key_fields = [df.schema[k] for k in keys]
    out_type = T.StructType.fromDDL(out)
    full = T.StructType(key_fields + out_type.fields + [T.StructField("late_rows", T.LongType())])

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        blob, last, late = state.get if state.exists else (None, None, 0)
        value = json.loads(blob) if blob is not None else None
        pdf = pd.concat(list(batches)).sort_values(order, kind="stable")
        places = list(pdf[order].itertuples(index=False, name=None))
        if last is not None:
            ready = [place >= tuple(json.loads(last)) for place in places]
            late += len(pdf) - sum(ready)
            pdf = pdf[ready]
        rows = []
        cols = [c for c in pdf.columns if c not in keys]
        for values in pdf[cols].itertuples(index=False, name=None):
            value, emitted = rule.step(value, {c: (None if _missing(v) else v) for c, v in zip(cols, values)})
            rows.extend(emitted)
        if len(pdf):
            last = _dump([v.item() if hasattr(v, "item") else v for v in places[-1]])
        state.update((_dump(value), last, late))
        res = pd.DataFrame(rows, columns=out_type.names)
        for k, v in zip(keys, key):
            res.insert(0, k, v)
        res["late_rows"] = late
        yield res.astype({f.name: object for f in out_type.fields if not isinstance(f.dataType, (T.DoubleType, T.FloatType))})[full.names]

    return df.groupBy(*keys).applyInPandasWithState(run, full, "blob string, last string, late bigint", "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, path: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Run a stream over everything available into parquet and read it back (tests and batch catch-up)."""
    q = (stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint or f"{path}-cp")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def grid_counts(df: DataFrame, keys: list[str], ts: str, bin_: str, late: str) -> DataFrame:
    """STR-07: per key and tumbling bin, rows and extremes; bins close once the watermark passes them."""
    w = df.withWatermark(ts, late).groupBy(F.window(ts, bin_).alias("_w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))
    return w.select(*keys, F.col("_w.start").alias("bin_start"), "n", "top")


def smeared_bins(df: DataFrame, keys: list[str], ts: str, width: str, slide: str, late: str) -> DataFrame:
    """STR-07: the smear of a target over neighbouring bins is a sliding window."""
    w = df.withWatermark(ts, late).groupBy(F.window(ts, width, slide).alias("_w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return w.select(*keys, F.col("_w.start").alias("bin_start"), "n")


def session_spans(df: DataFrame, keys: list[str], ts: str, gap: str, late: str) -> DataFrame:
    """STR-06: spans of one label by pauses alone (use :func:`fieldtrace.streaming.rules.run_rule` where a
    change of label must close the span)."""
    w = df.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("_w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return w.select(*keys, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "n")


def batch_name(checkpoint: str, epoch: int) -> str:
    """Name of a stream's batch that a replay shares and no other stream has."""
    import hashlib

    return f"{hashlib.sha256(checkpoint.encode()).hexdigest()[:16]}-{epoch}"


def other_batches(spark, path: str, name: str) -> DataFrame | None:
    """Rows that all other batches wrote, or None: a batch that failed half-way is not read by its replay."""
    from py4j.protocol import Py4JJavaError

    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    try:
        found = [str(s.getPath().getName()) for s in fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(fs_path)]
    except Py4JJavaError:  # no folder yet
        return None
    rest = [f"{path}/{n}" for n in found if n.startswith("batch=") and n != f"batch={name}"]
    return spark.read.parquet(*rest) if rest else None


def work_batch(batch: DataFrame, name: str, done_path: str, parked_path: str, work, keys: list[str]) -> None:
    """STR-08: one batch of a :func:`work_queue`. Results lie in the batch's own folder, which a replay writes anew from
    the same jobs, so a failure between two writes neither loses a job nor counts it twice."""
    from fieldtrace.session import cut_lineage

    todo = batch.dropDuplicates(keys)
    for path in (done_path, parked_path):
        earlier = other_batches(batch.sparkSession, path, name)
        if earlier is not None:
            todo = todo.join(earlier.select(*keys).distinct(), keys, "left_anti")
    res = cut_lineage(work(todo))
    for path, cond in ((done_path, "ok"), (parked_path, "not ok")):
        res.filter(cond).drop("ok").write.mode("overwrite").parquet(f"{path}/batch={name}")


def work_queue(arrivals: DataFrame, done_path: str, parked_path: str, work, keys: list[str], checkpoint: str):
    """STR-08: arriving jobs run once: jobs already done or parked are skipped, jobs whose result says
    failed are parked. ``work`` maps a DataFrame of jobs to the same jobs with ``ok`` and ``note``."""

    def handle(batch: DataFrame, epoch: int) -> None:
        work_batch(batch, batch_name(checkpoint, epoch), done_path, parked_path, work, keys)

    return arrivals.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_revisions(batch: DataFrame, log_path: str, expected: int | None = None, name: str | None = None) -> None:
    """STR-09: append the batch's imports (run, source_key, seq, payload) as new revisions of their run.

    An import already in the log is skipped when its payload is the same and an error when it is not; a
    stale ``expected`` revision is an error. Inside ``foreachBatch`` give the batch's ``name`` (see
    :func:`batch_name`): its rows lie in a folder of their own, and a replay reads the other batches and writes that
    folder anew. A log is kept with names or without.
    """
    from fieldtrace.operators.ordered import row_number, scan
    from fieldtrace.session import cut_lineage
    from fieldtrace.sources.stage import stage_complete

    spark = batch.sparkSession
    digest = batch.groupBy("run", "source_key").agg(F.sha2(F.concat_ws("\0", F.transform(F.array_sort(F.collect_list(F.struct("seq", "payload"))), lambda r: r["payload"])), 256).alias("_d"))
    fresh = batch.join(digest, ["run", "source_key"])
    top = None
    log = other_batches(spark, log_path, name) if name is not None else spark.read.parquet(log_path) if stage_complete(spark, log_path) else None
    if log is not None:
        known = log.select("run", "source_key", F.col("digest").alias("_old")).distinct()
        clash = digest.join(known, ["run", "source_key"]).filter(F.col("_d") != F.col("_old"))
        if not clash.isEmpty():
            raise ValueError("an import key was used before for different corrections")
        fresh = fresh.join(known.drop("_old"), ["run", "source_key"], "left_anti")
        top = log.groupBy("run").agg(F.max("revision").alias("_top"))
    fresh = cut_lineage(fresh)
    if fresh.isEmpty():
        return
    if expected is not None:
        have = fresh.select("run").distinct()
        now = have.join(top, "run", "left") if top is not None else have.withColumn("_top", F.lit(None).cast("bigint"))
        if not now.filter(F.coalesce("_top", F.lit(0)) != expected).isEmpty():
            raise ValueError("the run has newer reviews; reload before applying")
    # imports in order of first row, rows of an import together
    first = fresh.groupBy("run", "source_key").agg(F.min("seq").alias("_s"))
    d = scan(fresh.join(first, ["run", "source_key"]), ["run"], ["_s", "source_key", "seq"], {"_r": row_number()})
    d = d.join(top, "run", "left") if top is not None else d.withColumn("_top", F.lit(0))
    out = d.select("run", "source_key", "seq", "payload", F.col("_d").alias("digest"), (F.coalesce("_top", F.lit(0)) + F.col("_r")).cast("long").alias("revision"))
    if name is None:
        out.write.mode("append").parquet(log_path)
    else:
        out.write.mode("overwrite").parquet(f"{log_path}/batch={name}")
