"""ML-07 roles on known shapes; AGG-25 radii on literals."""

import random

import pytest

from fieldtrace.operators import uncertainty
from fieldtrace.plans import pitch


@pytest.mark.parametrize("name", list(pitch.SHAPES))
def test_roles_of_a_known_shape(spark, name):
    rng = random.Random(5)
    slots = [(d, w) for d, ws in pitch.SHAPES[name] for w in ws]
    rows, want = [], {}
    for f in range(6):
        order = list(range(10))
        rng.shuffle(order)  # players swap slots from frame to frame
        for player, s in enumerate(order):
            d, w = slots[s]
            rows.append((f, player, 20 + 50 * d + rng.uniform(-0.3, 0.3), 5 + 55 * w + rng.uniform(-0.3, 0.3)))
            want[f, player] = f"{name}:slot-{s + 1}"
        rows.append((f, 99, 2.0, 30.0))
        want[f, 99] = "deepest_player_proxy"
    rows += [(7, p, float(p), float(p)) for p in range(10)] + [(8, p, float(p), float("nan")) for p in range(11)]
    got = {r["f"]: r for r in pitch.formation(spark.createDataFrame(rows, "f int, player int, x double, y double"), ["f"]).collect()}
    assert {(f, x["player"]): x["role"] for f in range(6) for x in got[f]["roles"]} == want
    assert all(got[f]["shape"] == name and got[f]["error"] < 0.05 for f in range(6))
    assert all(got[f]["shape"] == "unknown" and got[f]["roles"] == [] and got[f]["error"] is None for f in (7, 8))


def test_radii_come_from_calibration_alone(spark):
    cal = spark.createDataFrame([("g", 0.5, float(i)) for i in range(11)] + [("g", 1.0000005, 50.0), ("g", 2.5, 7.0)], "g string, age double, err double")
    radii = {r["bucket"]: r["radius"] for r in uncertainty.age_radii(cal, ["g"], "age", "err").collect()}
    assert radii == {1: 10.0, 2: 50.0, 3: 7.0}  # the row a hair above one second is in the first two buckets
    test = spark.createDataFrame([("g", 0.0), ("g", 1.0), ("g", 1.5), ("g", 9.0), ("h", 1.0)], "g string, age double")
    got = sorted((r["g"], r["age"], r["radius"]) for r in uncertainty.with_radii(test, uncertainty.age_radii(cal, ["g"], "age", "err"), ["g"], "age").collect())
    assert got == [("g", 0.0, 10.0), ("g", 1.0, 10.0), ("g", 1.5, 50.0), ("g", 9.0, 7.0), ("h", 1.0, None)]
