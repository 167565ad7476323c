"""Decisions from scores and distributions, with abstention as a value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def restrict_to_lineup(p: Column, lineup: Column) -> Column:
    """FN-18: a distribution whose last cell is "unreadable" limited to the lineup's indices.

    The unreadable mass stays; the rest is renormalised over the lineup, or spread evenly over it
    when it holds no mass. A null or empty lineup changes nothing.
    """
    last = F.size(p) - 1
    legible = F.lit(1.0) - F.get(p, last)
    picked = F.array_sort(F.array_distinct(lineup))
    mass = F.aggregate(picked, F.lit(0.0), lambda a, i: a + F.get(p, i))

    def cell(v, i):
        inside = F.when(mass > 0, v / mass * legible).otherwise(legible / F.size(picked))
        return F.when(i == last, v).when(F.array_contains(picked, i), inside).otherwise(0.0)

    return F.when(F.size(F.coalesce(lineup, F.array().cast("array<int>"))) == 0, p).otherwise(F.transform(p, cell))


def read_distribution(p: Column, min_score: float, min_legible: float) -> Column:
    """FN-30: first most likely number with score and legibility floors, else abstain."""
    numbers = F.slice(p, 1, F.size(p) - 1)
    score = F.array_max(numbers)
    number = (F.array_position(numbers, score) - 1).cast("int")
    legible = F.lit(1.0) - F.get(p, F.size(p) - 1)
    ok = (score >= min_score) & (legible >= min_legible)
    return F.struct(number.alias("top"), score.alias("score"), F.when(ok, "provisional").otherwise("abstain").alias("status"),
                    F.when(ok, number).alias("number"))


def read_digits(digits: Column, floor: float, overlap: float, max_digits: int) -> Column:
    """FN-30: number from digit boxes array<struct<label,score,x1,y1,x2,y2>> (label one digit).

    The weaker of two overlapping digits is dropped, the rest read left to right; no digit, too many
    digits or a leading zero abstain. The score is that of the weakest digit.
    """
    from fieldtrace.functions.geometry import iou

    def box(d):
        return d["x1"], d["y1"], d["x2"], d["y2"]

    good = F.filter(digits, lambda d: d["label"].rlike("^[0-9]$") & (d["score"] >= floor))
    # stable by score descending: original position breaks ties
    ranked = F.array_sort(F.transform(good, lambda d, i: F.struct((-d["score"]).alias("o"), i.alias("i"), d.alias("d"))))
    ranked = F.transform(ranked, lambda r: r["d"])
    empty = F.filter(good, lambda d: F.lit(False))
    kept = F.aggregate(ranked, empty, lambda acc, d: F.when(
        F.exists(acc, lambda a: iou(box(a), box(d)) > overlap), acc).otherwise(F.concat(acc, F.array(d))))
    ordered = F.array_sort(F.transform(kept, lambda d: F.struct(
        ((d["x1"] + d["x2"]) / 2.0).alias("c"), d["label"].alias("label"), d["score"].alias("score"))))
    text = F.array_join(F.transform(ordered, lambda d: d["label"]), "")
    n = F.size(ordered)
    reason = (F.when(n == 0, "no_digit_detected").when(n > max_digits, "too_many_digits")
              .when((n == 2) & text.startswith("0"), "leading_zero").otherwise("digits_read_left_to_right"))
    ok = reason == "digits_read_left_to_right"
    return F.struct(F.when(ok, text.try_cast("int")).alias("number"),
                    F.when(ok, F.array_min(F.transform(ordered, lambda d: d["score"]))).otherwise(0.0).alias("score"),
                    reason.alias("reason"))


def logit(values: dict[str, Column], weights: dict[str, float], bias: float, mean: dict[str, float],
          std: dict[str, float], impute: dict[str, float]) -> Column:
    """FN-23: standardised linear score clipped to +-30; null and infinite inputs are imputed, a null
    boolean counts one half."""
    z = F.lit(float(bias))
    for name, w in weights.items():
        v = values[name]
        v = F.when(v.isNull() | (v == float("inf")), F.lit(float(impute.get(name, 0.0)))).otherwise(v.cast("double"))
        z = z + F.lit(float(w)) * ((v - F.lit(float(mean.get(name, 0.0)))) / F.lit(float(std.get(name, 1.0) or 1.0)))
    return F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def half_if_null(flag: Column) -> Column:
    return F.when(flag.isNull(), 0.5).otherwise(flag.cast("double"))


def argmax_entry(weights: Column) -> Column:
    """Entry struct(key, value) of a map with the largest value; the smallest key wins a tie."""
    ranked = F.array_sort(F.transform(F.map_entries(weights), lambda e: F.struct(
        (-e["value"]).alias("o"), e["key"].alias("key"), e["value"].alias("value"))))
    return F.get(ranked, F.lit(0))


# Fixed names in stored verdicts.
MADE = "made_fg"
TEAM_CHOICE = "team_unattributed"


def compose_verdict(outcome: Column, scorer: Column, p_assist: Column, pass_from: Column, pass_to: Column,
                    p_anomaly: Column, structural: Column) -> Column:
    """FN-27: outcome at probability .5 or more else "unclear"; on a made shot the scorer at .6 and the
    last passer at .6 if the pass went to that scorer; found contradictions are listed.

    ``outcome`` and ``scorer`` map choices to probabilities.
    """
    top, who = argmax_entry(outcome), argmax_entry(scorer)
    label = F.when(top["value"] >= 0.5, top["key"]).otherwise("unclear")
    made = label == MADE
    scorer_id = F.when(made & (who["key"] != TEAM_CHOICE) & (who["value"] >= 0.6), who["key"])
    assist_id = F.when((p_assist >= 0.6) & (pass_to == scorer_id), pass_from)
    flags = F.when(p_anomaly >= 0.5, F.concat(structural, F.array(F.lit("trace_self_contradiction")))).otherwise(structural)
    return F.struct(label.alias("outcome"), scorer_id.alias("scorer"), assist_id.alias("assist"),
                    F.coalesce(F.try_element_at(outcome, label), top["value"]).alias("confidence"), flags.alias("anomalies"))


def structural_flags(n_made: Column, control_teams: Column, offense: Column) -> Column:
    """FN-26: a made shot in a trace where the offence, or nobody, ever controlled the ball."""
    n = F.size(control_teams)
    other = (n_made > 0) & offense.isNotNull() & (n > 0) & ~F.coalesce(F.array_contains(control_teams, offense), F.lit(False))
    nobody = (n_made > 0) & (n == 0)
    return F.array_compact(F.array(F.when(other, "made_shot_without_offense_control"),
                                   F.when(nobody, "made_shot_without_any_ball_control")))


def thin(keys: list[Column], seed: int, drop_share: float) -> Column:
    """FN-24: deterministic Bernoulli keep flag from a hash of the row key."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1_000_000)) >= F.lit(int(drop_share * 1_000_000))


def offense_cluster(new: Column, old: Column) -> Column:
    """FN-22: the current column, else the legacy court end (left is 0, right is 1)."""
    return F.coalesce(new, F.when(old == "left", 0).when(old == "right", 1))


def round_binary(x: Column, digits: int) -> Column:
    """FN-25: a double rounded to ``digits`` places by its exact binary value, ties to even (2.675 gives 2.67).

    Spark's own rounding goes by the decimal text. Here the product with the power of ten is split into its nearest
    double and what that misses, and the missing part decides what looks like a tie.
    """
    scale = float(10 ** digits)
    high = lambda v: v * 134217729.0 - (v * 134217729.0 - v)  # noqa: E731  upper half of the digits of a double
    s_hi = scale * 134217729.0 - (scale * 134217729.0 - scale)
    p, x_hi, s_lo = x * scale, high(x), scale - s_hi
    missed = ((x_hi * s_hi - p) + x_hi * s_lo + (x - x_hi) * s_hi) + (x - x_hi) * s_lo
    below = F.floor(p).cast("double")
    tie = (p - below) == 0.5
    whole = F.when(tie & (missed > 0), below + 1).when(tie & (missed < 0), below).otherwise(F.rint(p))
    return F.when(F.abs(p) < 2.0 ** 52, whole / scale).otherwise(x)
