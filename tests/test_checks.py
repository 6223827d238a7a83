"""Checks on replicas and trajectories."""

import math

from convspan.operators import checks


def test_replicas(spark):
    rows = [("same", r, 1.5) for r in range(3)] + [("short", r, 1.5) for r in range(2)] + [("twice", r, 1.5) for r in (0, 0, 1)] + [("other", r, 1.5 + (r == 2)) for r in range(3)] + [("nan", r, math.nan) for r in range(3)]
    got = {r.name: (r.value, r.fault) for r in checks.replicated(spark.createDataFrame(rows, "name string, replica int, value double"), ["name"], 3).collect()}
    assert got == {"same": (1.5, None), "short": (None, "not one value a device"), "twice": (None, "not one value a device"), "other": (None, "replicas differ"), "nan": (None, "replicas differ")}


def run(spark, change=lambda s, row: row, steps=8):
    rows = [change(s, (s, 2.0 + 0.01 * s, 10.0, 100, 0.0 if s == 1 else 0.1)) for s in range(1, steps + 1)]
    return spark.createDataFrame([r for r in rows if r], "step long, loss double, denominator double, tokens long, rate double")


def test_verdicts(spark):
    reference = run(spark)
    verdict = lambda change, **more: checks.trajectory_verdict(run(spark, change), reference, 0.01, 0.01, 0.001, 0.01, **more).first()
    same = verdict(lambda s, r: r)
    assert same.passed and (same.steps, same.faults, same.outside, same.start_step) == (8, 0, 0, 3)
    assert verdict(lambda s, r: (s, r[1] * 1.2, *r[2:])).outside == 8
    assert verdict(lambda s, r: None if s == 4 else r).faults == 1
    for k, value in ((2, 10.1), (3, 99), (4, 0.2)):
        changed = verdict(lambda s, r: (*r[:k], value, *r[k + 1 :]) if s == 5 else r)
        assert changed.faults == 1 and not changed.passed
    drift = verdict(lambda s, r: (s, r[1] * (1 + 0.0015 * s), *r[2:]))
    assert drift.outside == 0 and drift.slope > 0.001 and not drift.passed
    still = verdict(lambda s, r: (*r[:4], 0.0))
    assert still.start_step is None and not still.passed and verdict(lambda s, r: r, start_step=5).start_step == 5
