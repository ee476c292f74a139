"""Scans and merges in pieces against plain loops."""

import random
from datetime import datetime, timedelta

import numpy as np

from brontide.operators import heal, history, spatial, summary

T0 = datetime(2024, 1, 1)


def test_prefix_medians():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 7, 300):
        x = np.round(rng.normal(size=n), 1)
        x[rng.random(n) < 0.2] = np.nan
        got = history.prefix_medians(x)
        for k in range(n):
            known = x[: k + 1][~np.isnan(x[: k + 1])]
            assert np.isnan(got[k]) if not len(known) else got[k] == np.median(known)


def test_trust_over_many_blocks(spark):
    rng = random.Random(2)
    kinds = [("NORMAL", None), ("SUSPECT", "LOW"), ("SENSOR_FAULT", "LOW"), ("SENSOR_FAULT", "CRITICAL"), ("SENSOR_FAULT", None)]
    rows, want = [], {}
    for s, steps in (("A", 1500), ("B", 3), ("C", 400)):
        at, now = T0, {"A": 100.0, "B": 100.0, "C": 12.5}[s]
        for k in range(steps):
            at += timedelta(hours=rng.choice((1, 1, 1, 60)))
            status, severity = rng.choices(kinds, (20, 2, 2, 1, 1) if k // 90 % 2 else (5, 1, 2, 3, 2))[0]
            change = {"NORMAL": 0.5, "SUSPECT": 0.0}.get(status, -{"LOW": 2.0, "CRITICAL": 20.0, None: 2.0}[severity])
            now = min(max(now + change, 0.0), 100.0)
            rows.append((s, "temp_c", at, status, severity, [k, k + 1], k))
            want[s, at] = (now, k)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "station_id string, variable string, ts timestamp, status string, severity string, extra array<int>, k int")
    start = spark.createDataFrame([("C", "temp_c", 12.5)], "station_id string, variable string, trust double")
    got = heal.trust_scores(df, start)
    assert got.columns == [*df.columns, "trust"]
    assert {(r["station_id"], r["ts"]): (r["trust"], r["k"]) for r in got.collect()} == want
    assert heal.trust_scores(df.limit(0)).collect() == []


def test_intervals_over_many_slices(spark):
    rng = random.Random(3)
    for spread, longest in ((2000, 30), (400, 300), (9000, 5)):
        spans = [(a, a + rng.randrange(longest)) for a in (rng.randrange(spread) for _ in range(150))]
        df = spark.createDataFrame([(T0 + timedelta(hours=a), T0 + timedelta(hours=b)) for a, b in spans], "start timestamp, end timestamp")
        got = {r["start"]: r["event"] for r in summary.joined_intervals(df, slice_s=rng.choice((3600 * 24, 3600 * 500))).collect()}
        event, reach, want = 0, None, {}
        for a, b in sorted(spans):
            if reach is None or a > reach + 1:
                event += 1
            reach = b if reach is None else max(reach, b)
            want[T0 + timedelta(hours=a)] = event
        assert got == want


def test_intervals_of_neighbours(spark):
    rng = random.Random(4)
    rows = [(s, T0 + timedelta(seconds=rng.randrange(86400)), rng.choice((20.0, 30.0, None, 200.0)), rng.choice((-1.5, 0.25, 2.0, None))) for s in "ABC" for _ in range(60)]
    df = spark.createDataFrame([(s, t, "temp_c", v, a if v is not None else None) for s, t, v, a in rows], "station_id string, ts timestamp, variable string, value double, anomaly double")
    edges = spark.createDataFrame([("A", "B"), ("A", "C"), ("B", "A")], "station_id string, neighbour_id string")
    got = {(r["station_id"], r["ts"]): r["near_anomaly"] for r in spatial.interval_anomaly(df, edges).collect()}
    want = {}
    for s, t, _, _ in rows:
        near = [a for n, u, v, a in rows if (s, n) in {("A", "B"), ("A", "C"), ("B", "A")} and abs(u - t) <= timedelta(hours=2) and v is not None and v <= 55 and a is not None]
        if near:
            want[s, t] = float(np.median(near))
    assert got == want
