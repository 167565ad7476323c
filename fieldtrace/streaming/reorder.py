"""Rules over streams that arrive out of order: rows wait until the watermark has passed them, then go on in event order.

A key's state is the rule's state, the clock of its last row and the rows that still wait. An event-time timer wakes the
key when its first waiting row is final, so a rule sees each key's rows sorted whatever files and triggers brought them,
as long as no row is later than ``late``; Spark drops and counts those beyond (``numRowsDroppedByWatermark``). A key
that is silent for ``idle`` is closed: the rule's closing rows go out and its state goes away. The pause is judged by
event time, so it closes the same spans when all rows come at once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fieldtrace.operators.folds import Rule, _dump, _missing

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CLOCK = "event_clock_ms"  # no leading underscore: the rows come as named tuples


def _plain(v):
    return None if _missing(v) else v.item() if hasattr(v, "item") else v


class _Reorder(StatefulProcessor):
    def __init__(self, keys: list[str], ts: str, order: list[str], rule: Rule, out: T.StructType, idle_ms: int | None):
        self.keys, self.ts, self.order, self.rule, self.out, self.idle = keys, ts, order, rule, out, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "clock bigint, row string")
        self.known = handle.getValueState("known", "blob string, clock bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            cols = [c for c in pdf.columns if c not in (*self.keys, self.ts, CLOCK)]
            for clock, *values in pdf[[CLOCK, *cols]].itertuples(index=False, name=None):
                self.waiting.appendValue((int(clock), json.dumps({c: _plain(v) for c, v in zip(cols, values)})))
                first = int(clock) if first is None else min(first, int(clock))
        if first is not None:
            self.handle.registerTimer(first)
        yield self.frame(key, [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = [(int(c), json.loads(r)) for c, r in self.waiting.get()]
        ready = sorted((r for r in held if r[0] <= now), key=lambda r: (r[0], *[r[1][c] for c in self.order]))
        later = [r for r in held if r[0] > now]
        blob, last = self.known.get() if self.known.exists() else (None, None)
        value, out = None if blob is None else json.loads(blob), []
        for clock, row in ready:
            if self.idle is not None and last is not None and clock - last > self.idle:
                out.extend(self.rule.close(value))
                value = None
            value, emitted = self.rule.step(value, row)
            out.extend(emitted)
            last = clock
        if ready:
            self.waiting.clear()
            for c, r in later:
                self.waiting.appendValue((c, json.dumps(r)))
        over = self.idle is not None and last is not None and now > last + self.idle and not any(c - last <= self.idle for c, _ in later)
        if over:
            out.extend(self.rule.close(value))
            self.known.clear()
        elif last is not None:
            self.known.update((_dump(value), last))
        wake = [min(c for c, _ in later)] if later else []
        if self.idle is not None and last is not None and not over:
            wake.append(last + self.idle + 1)
        for at in wake:
            self.handle.registerTimer(at)
        yield self.frame(key, out)

    def frame(self, key, rows) -> pd.DataFrame:
        res = pd.DataFrame([r if isinstance(r, dict) else dict(zip(self.out.names, r)) for r in rows], columns=self.out.names)
        for k, v in reversed(list(zip(self.keys, key))):
            res.insert(0, k, v)
        return res.astype({f.name: object for f in self.out.fields if not isinstance(f.dataType, (T.DoubleType, T.FloatType))})

    def close(self) -> None:
        pass


def ordered_stream(df: DataFrame, keys: list[str], ts: str, order: list[str], rule: Rule, out: str, late: str, idle_ms: int | None = None) -> DataFrame:
    """STR-01 to STR-06 on unordered streams: rows that ``rule`` emits, per key in order of ``ts`` in milliseconds and then
    ``order``, which tells finer clocks and ties apart. The rule sees all columns but the keys and ``ts``.

    ``late`` is the watermark's delay, for instance "10 minutes"; a row waits that long. Without ``idle_ms`` a key is
    never closed. State is kept in RocksDB, as timers need it; the setting is that of the session.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    out_type = T.StructType.fromDDL(out)
    full = T.StructType([df.schema[k] for k in keys] + out_type.fields)
    # a row is final once the watermark, in whole milliseconds, is not before it
    d = df.withWatermark(ts, late).withColumn(CLOCK, F.ceil(F.unix_micros(ts) / 1000).cast("long"))
    return d.groupBy(*keys).transformWithStateInPandas(_Reorder(keys, ts, order, rule, out_type, idle_ms), full, "append", "eventTime")
