"""Sequential rules: a fold per key whose state depends on earlier decisions.

:func:`fold` runs a small step function over the rows of each key in order. A hot key is cut into
clock slices; slices start from the end state of the slice before them, and only the slices whose
start state changed are run again, until nothing changes. That gives the exact sequential result
while no task holds more than one slice, and rules that soon forget their past settle in two rounds.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass
from itertools import accumulate
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from fieldtrace.operators.ordered import fill_forward, next_, row_number, running_sum, scan, with_slices
from fieldtrace.session import cut_lineage, spread


@dataclass(frozen=True)
class Rule:
    """``step(state, row) -> (state, rows out)`` and ``close(state) -> rows out``; state is JSON."""

    step: Callable[[Any, dict], tuple[Any, list[dict]]]
    close: Callable[[Any], list[dict]] = lambda state: []


def _run(pdf: pd.DataFrame, rule: Rule, order: list[str], state: Any) -> tuple[Any, list[dict]]:
    out = []
    cols = list(pdf.columns)
    for values in pdf.sort_values(order, kind="stable").itertuples(index=False, name=None):
        row = {c: (None if _missing(v) else v) for c, v in zip(cols, values)}
        state, rows = rule.step(state, row)
        out.extend(rows)
    return state, out


def _missing(v) -> bool:
    return v is None or (isinstance(v, float) and v != v) or v is pd.NA


def _dump(state: Any) -> str:
    return json.dumps(state, sort_keys=True, default=lambda o: o.item() if hasattr(o, "item") else list(o))


def _column(batch: pa.RecordBatch, i: int, nan) -> list:
    values = batch.column(i).to_pylist()
    return [nan if v != v else v for v in values] if pa.types.is_floating(batch.schema.field(i).type) else values


def _keys_in_turn(rule: Rule, n_keys: int, rest: list[str], full: T.StructType):
    """Fold of rows sorted by key and order: keys follow each other, so that a small key costs no Python call of its own."""
    schema = to_arrow_schema(full)
    names = full.names[n_keys:]

    def told(key: tuple, rows: list) -> list[tuple]:
        return [(*key, *(map(r.get, names) if isinstance(r, dict) else r)) for r in rows]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type, from_pandas=i >= n_keys) for i, (c, f) in enumerate(zip(columns, schema))], schema=schema)

    def run(batches):
        key, state = None, None
        for batch in batches:
            out = []
            keys = zip(*[_column(batch, i, math.nan) for i in range(n_keys)])  # one NaN object equals itself
            values = zip(*[_column(batch, n_keys + i, None) for i in range(len(rest))])
            for k, v in zip(keys, values):
                if k != key:
                    if key is not None:
                        out += told(key, rule.close(state))
                    key, state = k, None
                state, rows = rule.step(state, dict(zip(rest, v)))
                if rows:
                    out += told(key, rows)
            yield batch_of(out)
        if key is not None:
            yield batch_of(told(key, rule.close(state)))
    return run


def fold(df: DataFrame, keys: list[str], order: list[str], rule: Rule, out: str, hot_rows: int | None = None) -> DataFrame:
    """Rows emitted by ``rule``, with the keys in front. ``out`` is a DDL list of the emitted columns."""
    key_type = T.StructType([f for f in df.schema.fields if f.name in keys])
    out_type = T.StructType.fromDDL(out)
    full = T.StructType(key_type.fields + out_type.fields)

    def frame(rows, key):
        res = pd.DataFrame(rows, columns=out_type.names)
        for name, v in zip(key_type.names, key):
            res.insert(0, name, v)
        # object columns keep nulls and integers apart
        return res.astype({f.name: object for f in out_type.fields if not isinstance(f.dataType, (T.DoubleType, T.FloatType))})[full.names]

    sliced = with_slices(df, keys, order, hot_rows)
    if sliced is None:
        rest = [c for c in df.columns if c not in key_type.names]
        sort = [*key_type.names, *[F.col(c).asc_nulls_last() for c in order]]
        ready = spread(df.select(*key_type.names, *rest), key_type.names).sortWithinPartitions(*sort)
        return ready.mapInArrow(_keys_in_turn(rule, len(key_type.names), rest, full), full)

    part = [*key_type.names, "_slice"]
    rows = sliced.withColumn("_slice", F.coalesce("_slice", F.lit(0)))
    w = Window.partitionBy(*key_type.names).orderBy("_slice")
    states = cut_lineage(rows.select(*part).distinct().withColumn("_start", F.lit("null")).withColumn("_end", F.lit(None).cast("string")))
    state_type = states.select(*part, "_start", "_end").schema

    def settle(key: tuple, lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        start = rp["_start"].iloc[0]
        state, _ = _run(lp.drop(columns=part), rule, order, json.loads(start))
        return pd.DataFrame([[*key, start, _dump(state)]], columns=state_type.names)

    todo = states
    while True:
        run = rows.join(todo.select(*part), part, "left_semi").groupBy(*part).cogroup(todo.groupBy(*part)).applyInPandas(settle, state_type)
        run = cut_lineage(run)
        kept = states.join(run.select(*part), part, "left_anti")
        states = cut_lineage(kept.unionByName(run))
        fresh = states.withColumn("_new", F.coalesce(F.lag("_end").over(w), F.lit("null")))
        todo = cut_lineage(fresh.filter(F.col("_new") != F.col("_start")).select(
            *part, F.col("_new").alias("_start"), F.lit(None).cast("string").alias("_end")))
        if todo.isEmpty():
            break
    final = states.withColumn("_final", F.lead("_slice").over(w).isNull())

    def emit(key: tuple, lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        if not len(rp):
            return frame([], key[:-1])
        state, got = _run(lp.drop(columns=part), rule, order, json.loads(rp["_start"].iloc[0]))
        if rp["_final"].iloc[0]:
            got = got + rule.close(state)
        return frame(got, key[:-1])

    return rows.groupBy(*part).cogroup(final.groupBy(*part)).applyInPandas(emit, full)


# --- rules -----------------------------------------------------------------------------------

def min_gap_rule(t: str, take: list[str], gap: int, inclusive: bool = True) -> Rule:
    """WIN-07: keep a row when it comes ``gap`` or more (more than ``gap`` if not inclusive) after the
    last *kept* row."""
    def step(last, r):
        ahead = None if last is None else r[t] - last
        if ahead is None or ahead > gap or (inclusive and ahead == gap):
            return int(r[t]), [{c: r[c] for c in take}]
        return last, []
    return Rule(step)


def min_gap_sample(df: DataFrame, keys: list[str], order: list[str], gap: int, inclusive: bool = True,
                   hot_rows: int | None = None) -> DataFrame:
    """WIN-07 on a table: rows are kept whole."""
    take = [c for c in df.columns if c not in keys]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in take)
    return fold(df, keys, order, min_gap_rule(order[0], take, gap, inclusive), ddl, hot_rows)


def team_run_rule(max_gap: int) -> Rule:
    """WIN-02 over rows (t0, t1, team): a null team joins the current run, which adopts the first known
    team; a known other team or a pause beyond ``max_gap`` after the run's furthest end opens a new one."""
    def step(run, r):
        if run is not None:
            clash = r["team"] is not None and run["team"] is not None and r["team"] != run["team"]
            if not clash and r["t0"] - run["t1"] <= max_gap:
                return {"t0": run["t0"], "t1": max(run["t1"], int(r["t1"])), "contacts": run["contacts"] + 1,
                        "team": r["team"] if run["team"] is None else run["team"]}, []
        done = [] if run is None else [run]
        return {"t0": int(r["t0"]), "t1": int(r["t1"]), "team": r["team"], "contacts": 1}, done
    return Rule(step, lambda run: [] if run is None else [run])


def team_runs(df: DataFrame, keys: list[str], max_gap: int, hot_rows: int | None = None) -> DataFrame:
    """WIN-02."""
    team = df.schema["team"].dataType.simpleString()
    return fold(df.select(*keys, "t0", "t1", "team"), keys, ["t0", "t1"], team_run_rule(max_gap),
                f"t0 bigint, t1 bigint, team {team}, contacts bigint", hot_rows)


def window_rule(max_gap: int, max_length: int) -> Rule:
    """WIN-03 over rows (frame, ts, end_label, x1..y2): merge hits with compatible or null labels, close
    together and within ``max_length`` of the window's start; boxes are united, a null label inherits."""
    def step(w, r):
        if w is not None:
            same = w["court_end"] is None or r["court_end"] is None or w["court_end"] == r["court_end"]
            if same and r["ts"] - w["ts_end"] <= max_gap and r["ts"] - w["ts_start"] <= max_length:
                return {**w, "frame_end": int(r["frame"]), "ts_end": int(r["ts"]), "n_obs": w["n_obs"] + 1,
                        "court_end": r["court_end"] if w["court_end"] is None else w["court_end"],
                        "x1": min(w["x1"], r["x1"]), "y1": min(w["y1"], r["y1"]),
                        "x2": max(w["x2"], r["x2"]), "y2": max(w["y2"], r["y2"])}, []
        new = {"frame_start": int(r["frame"]), "frame_end": int(r["frame"]), "ts_start": int(r["ts"]), "ts_end": int(r["ts"]),
               "court_end": r["court_end"], "n_obs": 1, **{c: float(r[c]) for c in ("x1", "y1", "x2", "y2")}}
        return new, [] if w is None else [w]
    return Rule(step, lambda w: [] if w is None else [w])


def merge_windows(df: DataFrame, keys: list[str], max_gap: int = 2500, max_length: int = 6000,
                  hot_rows: int | None = None) -> DataFrame:
    """WIN-03."""
    cols = ["frame", "ts", "court_end", "x1", "y1", "x2", "y2"]
    return fold(df.select(*keys, *cols), keys, ["frame", "ts"], window_rule(max_gap, max_length),
                "frame_start bigint, frame_end bigint, ts_start bigint, ts_end bigint, court_end string, n_obs bigint, "
                "x1 double, y1 double, x2 double, y2 double", hot_rows)


def peaks(df: DataFrame, keys: list[str], bin_: str, prob: str, threshold: float, separation: int,
          hot_rows: int | None = None) -> DataFrame:
    """WIN-28: local maxima over ``separation`` rows either side (a ROWS frame), then at least
    ``separation`` bins after the last accepted peak (a fold over the few maxima left)."""
    from fieldtrace.operators.frames import rows_frame

    d = rows_frame(df.select(*keys, bin_, prob), keys, [bin_], -separation, separation, {"_top": F.max(prob)}, hot_rows=hot_rows)
    tops = d.filter((F.col(prob) >= threshold) & (F.col(prob) >= F.col("_top"))).drop("_top")
    return min_gap_sample(tops, keys, [bin_], separation, hot_rows=hot_rows)


# Fixed values of the score rule.
VALID_STEPS = (1, 2, 3)


def score_step_rule() -> Rule:
    """WIN-31 over rows (t, before, after): a step of 1 to 3 that does not fall below the last accepted score."""
    def step(last, r):
        if r["before"] is None or r["after"] is None or r["after"] - r["before"] not in VALID_STEPS:
            return last, []
        if last is not None and r["before"] < last:
            return last, []
        return int(r["after"]), [{"t": r["t"], "before": r["before"], "after": r["after"], "delta": r["after"] - r["before"]}]
    return Rule(step)


def score_steps(df: DataFrame, keys: list[str], hot_rows: int | None = None) -> DataFrame:
    """WIN-31."""
    return fold(df.select(*keys, "t", "before", "after"), keys, ["t"], score_step_rule(),
                "t bigint, before bigint, after bigint, delta bigint", hot_rows)


def countdown_rule(jump: float, jitter: float) -> Rule:
    """WIN-32 over rows (t, clock, ahead = the next three confident clocks): an upward jump counts only
    if at least half of the readings ahead confirm it; beyond ``jump`` it opens a period."""
    def confirmed(r, floor, margin):
        ahead = list(r["ahead"]) if r["ahead"] is not None else []
        return bool(ahead) and 2 * sum(c - floor > margin for c in ahead) >= len(ahead)

    def step(state, r):
        period, last = state if state is not None else (1, None)
        rise = None if last is None else r["clock"] - last
        if rise is not None and rise > jump:
            if not confirmed(r, last, jump):
                return [period, last], []
            period += 1
        elif rise is not None and rise > jitter and not confirmed(r, last, jitter):
            return [period, last], []
        return [period, float(r["clock"])], [{"period": period, "clock": float(r["clock"]), "t": r["t"]}]
    return Rule(step)


def countdown_timeline(df: DataFrame, keys: list[str], jump: float = 240.0, jitter: float = 3.0, lookahead: int = 3,
                       hot_rows: int | None = None) -> DataFrame:
    """WIN-32: rows (t, clock) are the confident readings in video order."""
    from fieldtrace.operators.frames import rows_frame

    d = rows_frame(df.select(*keys, "t", F.col("clock").cast("double").alias("clock")), keys, ["t"], 1, lookahead,
                   {"ahead": F.collect_list("clock")}, hot_rows=hot_rows)
    return fold(d, keys, ["t"], countdown_rule(jump, jitter), "period int, clock double, t bigint", hot_rows)


def chain_rule(max_gap: float, max_travel: float) -> Rule:
    """WIN-33 over rows (t, x, y, id): link to the chain with the latest tail within time and distance
    (the older chain wins a tie). The state holds only tails that can still be extended."""
    def step(state, r):
        nxt, tails = state if state is not None else (0, [])
        live = [c for c in tails if r["t"] - c["t"] <= max_gap]
        near = [c for c in live if r["t"] > c["t"] and ((c["x"] - r["x"]) ** 2 + (c["y"] - r["y"]) ** 2) ** 0.5 <= max_travel]
        best = max(near, key=lambda c: (c["t"], -c["chain"])) if near else None
        chain = nxt if best is None else best["chain"]
        tail = {"chain": chain, "t": float(r["t"]), "x": float(r["x"]), "y": float(r["y"])}
        live = [c for c in live if c["chain"] != chain] + [tail]
        return [nxt + (best is None), live], [{"id": r["id"], "chain": chain, "t": float(r["t"]), "x": float(r["x"]), "y": float(r["y"])}]
    return Rule(step)


def chain_candidates(df: DataFrame, keys: list[str], max_gap: float, max_travel: float, hot_rows: int | None = None) -> DataFrame:
    """WIN-33: chain number of each candidate (t, x, y, id)."""
    return fold(df.select(*keys, "t", "x", "y", "id"), keys, ["t", "id"], chain_rule(max_gap, max_travel),
                "id bigint, chain bigint, t double, x double, y double", hot_rows)


def believed_chains(chained: DataFrame, keys: list[str], anchored: DataFrame, min_rows: int, flight: float, dribble: float) -> DataFrame:
    """WIN-33: members of chains of ``min_rows`` or more that move: spread at flight scale, or at dribble
    scale with at least half of the members anchored to a player (``anchored`` lists their ids).

    The spread is the largest distance between members, found on the hull of each chain.
    """
    @F.pandas_udf("double")
    def spread_of(batch: pd.Series) -> pd.Series:
        from fieldtrace.operators.kernels import diameter
        return pd.Series([diameter([(p["x"], p["y"]) for p in ps]) for ps in batch])

    d = chained.join(anchored.select("id").distinct().withColumn("_a", F.lit(1)), "id", "left")
    g = d.groupBy(*keys, "chain").agg(F.count(F.lit(1)).alias("_n"), F.count("_a").alias("_an"), F.collect_set(F.struct("x", "y")).alias("_p")).filter(F.col("_n") >= min_rows)
    g = g.withColumn("spread", spread_of("_p"))
    ok = (F.col("spread") >= flight) | ((F.col("spread") >= dribble) & (F.col("_an") * 2 >= F.col("_n")))
    return chained.join(g.filter(ok).select(*keys, "chain", "spread"), [*keys, "chain"])


# Fixed event vocabularies of the interval rule.
CONTROL = ("PASS", "RECOVERY", "SET PIECE")
TERMINAL = ("BALL LOST", "BALL OUT", "SHOT", "FAULT RECEIVED")
STOPS_BOTH = ("BALL OUT", "FAULT RECEIVED")


def possession_intervals(events: DataFrame, keys: list[str], hot_rows: int | None = None) -> DataFrame:
    """WIN-22: ``events`` has t, seq (source order), period, team, kind, period_end.

    Who holds the ball before an event follows from the last control or dead ball before it and from whether the
    holder has lost it since. An event opens a possession if it is a control and nobody, or another team, holds, or
    play restarts; the rows up to the next opening are one group, which ends at its first loss, else at the next
    opening, else with the period. Possessions without length vanish and use no number.
    """
    rows = events.select(*keys, "t", "seq", "period", "team", "kind", "period_end")
    within, order, at = [*keys, "period"], ["t", "seq"], F.struct("t", "seq")
    control, dead = F.col("kind").isin(*CONTROL), F.col("kind").isin(*STOPS_BOTH)
    holder = F.struct(F.when(control, F.col("team")).alias("team"), at.alias("at"))
    d = scan(rows, within, order, {"_holder": fill_forward(F.when(control | dead, holder), inclusive=False)}, hot_rows)
    d = d.withColumn("_lost", F.col("kind").isin(*TERMINAL) & ~dead & F.coalesce(F.col("team") == F.col("_holder.team"), F.lit(False)))
    d = scan(d, within, order, {"_loss": fill_forward(F.when(F.col("_lost"), at), inclusive=False)}, hot_rows)
    held = F.col("_holder.team").isNotNull() & (F.col("_loss").isNull() | (F.col("_loss") < F.col("_holder.at")))
    opens = control & (~held | (F.col("team") != F.col("_holder.team")) | (F.col("kind") == "SET PIECE"))
    d = d.select("*", F.coalesce(opens, F.lit(False)).alias("_opens"), (held & (F.col("_lost") | dead)).alias("_ends"))
    d = scan(d, within, order, {"_no": running_sum(F.col("_opens").cast("long"))}, hot_rows).filter("_no > 0")
    first = F.struct("t", "seq", "team", "kind", "period_end")
    g = d.groupBy(*within, "_no").agg(F.min_by(first, F.when(F.col("_opens"), at)).alias("_o"), F.count_if(control).alias("events"),
                                      F.min_by(F.struct("t", "kind"), F.when(F.col("_ends"), at)).alias("_e"))
    g = scan(g, within, ["_no"], {"_n": next_(F.col("_o"))}, hot_rows)
    last = rows.groupBy(*keys).agg(F.max_by("period", F.struct("t", "seq")).alias("_last"))
    changes = F.when(F.col("_n.team") != F.col("_o.team"), "team_change").otherwise("restart")
    closing = F.when(F.col("period") == F.col("_last"), "recording_end").otherwise("period_end")
    g = g.join(last, keys).select(
        *keys, F.col("period").cast("int").alias("period"), F.col("_o.team").cast("int").alias("team"), F.col("_o.t").cast("double").alias("start"),
        F.coalesce("_e.t", "_n.t", "_o.period_end").cast("double").alias("end"), F.col("_o.kind").alias("start_reason"),
        F.coalesce(F.col("_e.kind"), F.when(F.col("_n").isNotNull(), changes), closing).alias("end_reason"), "events", F.col("_o.seq").alias("_seq"))
    g = scan(g.filter(F.col("end") > F.col("start")), keys, ["start", "_seq"], {"_rank": row_number()}, hot_rows)
    return g.select(*keys, (F.col("_rank") - 1).alias("possession"), "period", "team", "start", "end", "start_reason", "end_reason", "events")


@dataclass(frozen=True)
class Fusion:
    """Fixed values of the fusion rule (pixels and frames)."""

    gate_base: float = 60.0
    gate_grow: float = 40.0
    coast: int = 12
    min_rows: int = 4
    agree: float = 40.0
    strong: float = 0.3
    weak_gate: float = 0.6


def fuse_sensors(det: list, heat: list, cfg: Fusion) -> tuple[list, list]:
    """Candidates of one frame: a heat peak near a detection joins it, other strong peaks stand alone,
    weak peaks can only continue a track."""
    strong = [[x, y, c, "det"] for x, y, c in det]
    weak = []
    for x, y, c in heat:
        if c < cfg.strong:
            weak.append([x, y, c, "heat"])
            continue
        near = next((s for s in strong if ((s[0] - x) ** 2 + (s[1] - y) ** 2) ** 0.5 <= cfg.agree), None)
        if near is None:
            strong.append([x, y, c, "heat"])
        else:
            near[:] = [(near[0] + x) / 2, (near[1] + y) / 2, max(near[2], c), "both"]
    return strong, weak


def fusion_rule(cfg: Fusion = Fusion()) -> Rule:
    """WIN-10 over frames with candidates (frame, det, heat): a constant-velocity prediction claims the
    nearest candidate inside a gate that grows with the gap; short misses coast, longer ones end the
    segment, and a segment with fewer than ``min_rows`` confirmed rows is dropped.

    Rows are held back only until their segment is long enough, so the state stays small.
    """
    def row(s, frame, x, y, conf, source):
        return {"frame": frame, "x": x, "y": y, "conf": conf, "source": source, "seg": s["seg"]}

    def seed(seg, frame, strong):
        x, y, c, src = max(strong, key=lambda s: s[2])
        s = {"seg": seg, "frame": frame, "x": float(x), "y": float(y), "vx": 0.0, "vy": 0.0, "n": 1, "held": []}
        s["held"] = [row(s, frame, float(x), float(y), float(c), src)]
        return s

    def step(state, r):
        s = state or {"seg": 0, "frame": None}
        frame = int(r["frame"])
        strong, weak = fuse_sensors(_triples(r["det"]), _triples(r["heat"]), cfg)
        if s["frame"] is not None and frame - s["frame"] > cfg.coast:
            # the segment ended at the first frame beyond the coast, which is spent on ending it
            spent = frame == s["frame"] + cfg.coast + 1
            s = {"seg": s["seg"] + (s["n"] >= cfg.min_rows), "frame": None}
            if spent:
                return s, []
        if s["frame"] is None:
            return (seed(s["seg"], frame, strong) if strong else s), []
        gap = frame - s["frame"]
        px, py = s["x"] + s["vx"] * gap, s["y"] + s["vy"] * gap
        gate = cfg.gate_base + cfg.gate_grow * (gap - 1)

        def nearest(cands, reach):
            scored = [(((c[0] - px) ** 2 + (c[1] - py) ** 2) ** 0.5, i) for i, c in enumerate(cands)]
            scored = [v for v in scored if v[0] <= reach]
            return cands[min(scored)[1]] if scored else None

        hit = nearest(strong, gate) or nearest(weak, gate * cfg.weak_gate)
        if hit is None:
            return s, []
        x, y, c, src = float(hit[0]), float(hit[1]), float(hit[2]), hit[3]
        rows = [row(s, s["frame"] + i, s["x"] + s["vx"] * i, s["y"] + s["vy"] * i, 0.0, "interp") for i in range(1, gap)]
        rows.append(row(s, frame, x, y, c, src))
        s = {"seg": s["seg"], "frame": frame, "x": x, "y": y, "vx": (x - s["x"]) / gap, "vy": (y - s["y"]) / gap,
             "n": s["n"] + 1, "held": s["held"] + rows}
        if s["n"] >= cfg.min_rows:
            out, s["held"] = s["held"], []
            return s, out
        return s, []
    return Rule(step)


def _triples(v) -> list:
    return [] if v is None else [(c["x"], c["y"], c["conf"]) for c in v]


def fuse_track(candidates: DataFrame, keys: list[str], cfg: Fusion = Fusion(), hot_rows: int | None = None) -> DataFrame:
    """WIN-10: ``candidates`` has frame, sensor (det or heat), x, y, conf."""
    c = F.struct(F.col("conf").cast("double").alias("conf"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    per = candidates.groupBy(*keys, "frame").agg(
        F.sort_array(F.collect_list(F.when(F.col("sensor") == "det", c)), asc=False).alias("det"),
        F.sort_array(F.collect_list(F.when(F.col("sensor") == "heat", c)), asc=False).alias("heat"))
    return fold(per, keys, ["frame"], fusion_rule(cfg), "frame bigint, x double, y double, conf double, source string, seg bigint", hot_rows)


def bridge_segments(track: DataFrame, keys: list[str], max_frames: int = 45, max_speed: float = 90.0,
                    hot_rows: int | None = None) -> DataFrame:
    """WIN-10: segments close in time whose bridge is plausibly slow become one, with interpolated rows.

    A bridge looks only at the tail of the segment before and the head of the next, so it is a lag.
    """
    from fieldtrace.operators.ordered import prev, running_sum, scan

    ends = track.groupBy(*keys, "seg").agg(
        F.min("frame").alias("f0"), F.max("frame").alias("f1"), F.min_by(F.struct("x", "y"), "frame").alias("head"),
        F.max_by(F.struct("x", "y"), "frame").alias("tail"))
    d = scan(ends, keys, ["f0"], {"_p": prev(F.struct("f1", "tail"))}, hot_rows)
    gap = F.col("f0") - F.col("_p.f1")
    dx, dy = F.col("head.x") - F.col("_p.tail.x"), F.col("head.y") - F.col("_p.tail.y")
    joins = F.coalesce((gap > 0) & (gap <= max_frames) & (F.sqrt(dx * dx + dy * dy) / gap <= max_speed), F.lit(False))
    d = d.withColumn("_join", joins).withColumn("_o", (~joins).cast("int"))
    d = scan(d, keys, ["f0"], {"chain": running_sum(F.col("_o"))}, hot_rows)
    moved = track.join(d.select(*keys, "seg", "chain"), [*keys, "seg"]).drop("seg")
    fill = d.filter(F.col("_join") & (gap > 1)).select(
        *keys, "chain", F.explode(F.sequence(F.lit(1).cast("long"), gap - 1)).alias("_i"), gap.alias("_gap"), F.col("_p").alias("_p"), "head")
    share = F.col("_i") / F.col("_gap")
    fill = fill.select(*keys, (F.col("_p.f1") + F.col("_i")).alias("frame"), (F.col("_p.tail.x") + (F.col("head.x") - F.col("_p.tail.x")) * share).alias("x"),
                       (F.col("_p.tail.y") + (F.col("head.y") - F.col("_p.tail.y")) * share).alias("y"), F.lit(0.0).alias("conf"),
                       F.lit("interp").alias("source"), "chain")
    return moved.unionByName(fill)


@dataclass(frozen=True)
class Lock:
    """Fixed values of the lock sweep (milliseconds and body heights)."""

    overlap: float = 150.0
    coast: float = 2000.0
    gate_base: float = 0.6
    gate_grow: float = 1.2
    sim: float = 0.6
    sim_motion: float = 0.35
    bonus: float = 0.15
    motion_score: float = 0.9
    gallery: int = 16


class _Locks:
    """Locks of one sweep: one record each, the distinct vectors of their galleries, and per team the arrays that a
    segment is compared with.

    Segments come in start order, so of the intervals of a lock only the furthest end can still overlap one; a segment
    costs a few array operations over the locks of its team, however long the sweep is. Dumped as the list of records.
    """

    MOTION = ("busy", "t_last", "cx", "cy", "h", "vx", "vy")

    def __init__(self, records: list[dict]):
        import numpy as np

        self.records, self.teams, self.known, self.bank = [], {}, {}, np.zeros((16, 0))
        for i, r in enumerate(records):
            self.put(i, {**r, "gallery": [(q, self.vector(v)) for q, v in r["gallery"]]})
        self.full = 2 * len(self.known) + 1024  # beyond that, vectors that no gallery holds any more are left behind

    def __iter__(self):
        return ({**r, "gallery": [[q, self.bank[k].tolist()] for q, k in r["gallery"]]} for r in self.records)

    def vector(self, v) -> int:
        """Row of ``v`` in the bank; a shorter vector counts as filled with zeros."""
        import numpy as np

        v = tuple(float(x) for x in v)
        if v not in self.known:
            old = self.bank
            if len(self.known) == len(old) or len(v) > old.shape[1]:
                self.bank = np.zeros((2 * max(len(old), len(self.known)), max(len(v), old.shape[1])))
                self.bank[:len(old), :old.shape[1]] = old
            self.bank[len(self.known), :len(v)] = v
            self.known[v] = len(self.known)
        return self.known[v]

    def similar(self, row: int):
        """The vector against all."""
        return self.bank[:len(self.known)] @ self.bank[row]

    def put(self, i: int, record: dict) -> None:
        import numpy as np

        team = self.teams.setdefault(record["team"], {"number": [], "row": {}, "motion": np.zeros((len(self.MOTION), 4)), "gallery": np.zeros((4, 1), dtype=np.int64)})
        if i == len(self.records):
            self.records.append(record)
            team["row"][i] = len(team["number"])
            team["number"].append(i)
        self.records[i] = record
        at, old, held = team["row"][i], team["gallery"], list(dict.fromkeys(k for _, k in record["gallery"]))
        if at >= len(old) or len(held) > old.shape[1]:
            more = 2 * at if at >= len(old) else len(old)
            team["motion"] = np.concatenate([team["motion"], np.zeros((len(self.MOTION), more - len(old)))], axis=1)
            team["gallery"] = np.zeros((more, max(len(held), old.shape[1])), dtype=np.int64)
            team["gallery"][:len(old)] = old[:, :1]
            team["gallery"][:len(old), :old.shape[1]] = old
        team["motion"][:, at] = [record[c] for c in self.MOTION]
        team["gallery"][at] = held[0]  # free places repeat the first vector
        team["gallery"][at, :len(held)] = held


def lock_rule(cfg: Lock = Lock()) -> Rule:
    """WIN-35 over segments in start order: attach to the best compatible lock or open one.

    A lock is compatible when its team matches, no interval of it overlaps by more than the limit, and
    appearance (best cosine between galleries) reaches the floor, which is lower when the predicted
    position agrees. Without a gallery a segment attaches only if exactly one lock agrees in motion.
    """
    def step(state, r):
        import numpy as np

        locks = state if isinstance(state, _Locks) else _Locks(state or [])
        if len(locks.known) > locks.full:
            locks = _Locks(list(locks))
        gallery = None if r["gallery"] is None or not len(r["gallery"]) else [(float(g["q"]), locks.vector(g["v"])) for g in r["gallery"]]
        options, t0, t1 = [], float(r["t0"]), float(r["t1"])
        fx, fy = (np.nan if r[c] is None else float(r[c]) for c in ("fx", "fy"))
        team = locks.teams.get(r["team"])
        if team is not None:
            n = len(team["number"])
            busy, t_last, *rest = team["motion"][:, :n]
            free = np.minimum(t1, busy) - t0 <= cfg.overlap
            recent = np.flatnonzero(free & (t0 - t_last > 0) & (t0 - t_last <= cfg.coast))
            gap, (cx, cy, h, vx, vy) = t0 - t_last[recent], (c[recent] for c in rest)
            motion = np.zeros(n, dtype=bool)
            motion[recent] = np.hypot(cx + vx * gap - fx, cy + vy * gap - fy) <= (cfg.gate_base + cfg.gate_grow * gap / 1000) * h
            if gallery is None:
                options = [(cfg.motion_score, 0.0, team["number"][i], "motion") for i in np.flatnonzero(motion)]
            else:
                sim = np.max([locks.similar(k) for _, k in gallery], axis=0)[team["gallery"][:n]]
                sim = sim[:, 0] if sim.shape[1] == 1 else sim.max(axis=1)
                hits = np.flatnonzero(free & (sim >= np.where(motion, cfg.sim_motion, cfg.sim)))
                score = sim[hits] + np.where(motion[hits], cfg.bonus, 0.0)
                hits = hits[score == score.max()] if len(hits) else hits
                options = [(float(sim[i]) + (cfg.bonus if motion[i] else 0.0), float(sim[i]), team["number"][i], "motion+app" if motion[i] else "appearance") for i in hits]
        if gallery is None and len(options) != 1:
            return locks, [{"segment": r["segment"], "lock": None, "how": "ambiguous" if options else "no_gallery"}]
        kinematics = {k: float(r[k]) for k in ("t_last", "cx", "cy", "h", "vx", "vy")}
        if options:
            _, _, i, how = max(options)
            old = locks.records[i]
            merged = sorted(old["gallery"] + (gallery or []), key=lambda g: -g[0])[:cfg.gallery]
            new = {**old, "busy": max(old["busy"], t1), "gallery": merged}
            if kinematics["t_last"] >= old["t_last"]:
                new.update(kinematics)
            locks.put(i, new)
        else:
            i, how = len(locks.records), "opened"
            locks.put(i, {"team": r["team"], "busy": t1, "gallery": gallery, **kinematics})
        return locks, [{"segment": r["segment"], "lock": i, "how": how}]
    return Rule(step)


def sweep_locks(segments: DataFrame, keys: list[str], cfg: Lock = Lock(), hot_rows: int | None = None) -> DataFrame:
    """WIN-35: ``segments`` has segment, t0, t1, team, fx, fy (first centre), t_last, cx, cy, h, vx, vy
    (motion at the end) and gallery array<struct<q, v>> (null when too few clean crops)."""
    cols = ["segment", "t0", "t1", "team", "fx", "fy", "t_last", "cx", "cy", "h", "vx", "vy"]
    # flat arrays reach the tasks without a Python object for each crop
    flat = [F.transform("gallery", lambda g: g["q"].cast("double")).alias("_q"), F.transform("gallery", lambda g: F.size(g["v"])).alias("_n"),
            F.flatten(F.transform("gallery", lambda g: g["v"].cast("array<double>"))).alias("_v")]
    rule = lock_rule(cfg)

    def step(state, r):
        gallery = None
        if r["_q"] is not None:
            gallery = [{"q": q, "v": [float(x) for x in r["_v"][b - n:b]]} for q, n, b in zip(r["_q"], r["_n"], accumulate(r["_n"]), strict=True)]
        return rule.step(state, {**r, "gallery": gallery})

    return fold(segments.select(*keys, *cols, *flat), keys, ["t0", "segment"], Rule(step), "segment bigint, lock bigint, how string", hot_rows)
