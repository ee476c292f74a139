"""The station's state: clocks, late rows, bounded size; and the stream around it."""

import json
import random
from datetime import timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from brontide.config import VARIABLES
from brontide.operators import climatology, geo, ingest
from brontide.plans import catalogue, detect
from brontide.streaming.detector import detect_stream
from brontide.streaming.station import HOUR, Spreads, Station

DATA = "/root/testdata/sf0.001"


def row(station: str, hour: int, value: float = 20.0, hood=("B", "C"), tick: bool = False) -> dict:
    out = {"station_id": station, "ts": hour * HOUR, "tick": tick, "hood": list(hood), "kept": None, "dewpoint": 5.0}
    for v in VARIABLES:
        out |= {v: value, f"mean_{v}": 19.0, f"std_{v}": 1.0}
    return out


def hours(rows: list[dict]) -> list[int]:
    return [r["ts"] // HOUR for r in rows]


def test_an_hour_waits_for_all_neighbours():
    s = Station(None)
    s.take("A", [row("A", h) for h in range(5)] + [row("B", h) for h in range(5)] + [row("C", 2)])
    assert hours(s.ready("A", 0, 24)) == [0]
    s.take("A", [row("C", 6, tick=True)])
    assert hours(s.ready("A", 0, 24)) == [1, 2]


def test_one_clock_ahead_drops_and_delays_nothing():
    s = Station(None)
    s.take("A", [row("A", h) for h in range(6)] + [row(n, h) for n in "BC" for h in range(6)] + [row("B", 9000)])
    ready = s.ready("A", 0, 24)
    assert hours(ready) == [0, 1, 2, 3]
    s.judge("A", ready)
    assert s.take("A", [row("A", 6)]) == [] and hours(s.wait) == [4, 5, 6]
    # its own clock ahead: its row waits, the others go on
    s.take("A", [row("A", 8000), *[row(n, h) for n in "BC" for h in range(6, 12)]])
    assert hours(s.ready("A", 0, 24)) == [4, 5, 6]


def test_a_silent_neighbour_is_waited_for_so_long():
    s = Station(None)
    s.take("A", [row(n, h) for n in "AB" for h in range(40)])
    assert hours(s.ready("A", 0, 24)) == list(range(14))


def test_late_and_repeated_rows():
    s = Station(None)
    s.take("A", [row(n, h) for n in "ABC" for h in range(10)])
    s.judge("A", s.ready("A", 0, 24))
    late = s.take("A", [row("A", 3), row("A", 9, 50.0), row("A", 12)])
    assert hours(late) == [3] and [r["temp_c"] for r in s.wait if r["ts"] == 9 * HOUR] == [20.0]
    assert hours(s.wait) == [8, 9, 12]


def test_allowed_lateness():
    s = Station(None)
    s.take("A", [row(n, h) for n in "ABC" for h in range(20)])
    assert hours(s.ready("A", 12, 24)) == list(range(6))


def test_state_has_the_same_results_in_pieces_and_a_bounded_size():
    rng = random.Random(1)
    rows = {n: [row(n, h, round(20 + rng.gauss(0, 2), 2)) for h in range(3000)] for n in "ABC"}
    for h in rng.sample(range(3000), 200):
        for v in VARIABLES:
            rows["A"][h][v] = None
    whole = Station(None)
    whole.take("A", [r for x in rows.values() for r in x])
    want = whole.judge("A", whole.ready("A", 0, 24)).sort_values(["ts", "variable"]).reset_index(drop=True)
    text, got, sizes, at = None, [], [], 0
    while at < 3000:
        s, to = Station(text), at + rng.choice((1, 5, 80, 400))
        s.take("A", [r for x in rows.values() for r in x[at:to]])
        if ready := s.ready("A", 0, 24):
            got.append(s.judge("A", ready))
        text, at = s.text(), to
        sizes.append(len(text))
    got = pd.concat(got).sort_values(["ts", "variable"]).reset_index(drop=True)
    assert len(got) == len(want) == 3 * 2998
    for c in want.columns:
        if want[c].dtype == float:
            assert np.allclose(want[c], got[c], equal_nan=True, rtol=1e-9), c
        else:
            assert (want[c].astype(str) == got[c].astype(str)).all(), c
    assert json.loads(text)["seen"] == 2998 and sizes[-1] < 200_000


def test_median_of_spreads():
    rng = np.random.default_rng(2)
    s, all_ = Spreads([]), []
    for x in [0.0, 0.0, *rng.lognormal(0, 2, 500)]:
        s.add(float(x))
        all_.append(x)
        assert abs(s.median() - np.median(all_)) <= 1e-3 * np.median(all_)


@pytest.fixture(scope="module")
def net(spark):
    r = catalogue._readings(spark, DATA).where("station_id in ('ST-1', 'ST-2', 'ST-3', 'ST-4')")
    return r, geo.neighbour_edges(catalogue._stations(spark, DATA, 4)), climatology.fit_climatology(ingest.long_form(r))


SCHEMA = "station_id string, ts timestamp, event_id long, temp_c double, pressure_hpa double, rh_pct double"


def test_stream_with_a_clock_ahead_and_late_rows(spark, net, tmp_path):
    """One reading months ahead in the first file, one months late in the last: every other hour is judged as in one plan, and the late one is set aside."""
    r, edges, clim = net
    columns = ("station_id", "ts", "event_id", *VARIABLES)
    half = F.col("ts") < "2024-01-16"
    ahead = r.where("station_id = 'ST-2'").limit(1).withColumn("ts", F.lit("2024-06-01").cast("timestamp"))
    late = r.where("station_id = 'ST-1'").limit(1).withColumn("ts", F.lit("2023-01-01 05:00:00").cast("timestamp"))
    for part in (r.where(half).unionByName(ahead), r.where(~half).unionByName(late)):
        part.select(*columns).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    score = lambda x: x.withColumn("ml_score", catalogue._stand_in())
    got = detect_stream(spark, f"file://{tmp_path}/in", SCHEMA, edges, clim, score, f"file://{tmp_path}/run", {"event_id": "bigint"})
    batch = lambda readings: ingest.long_form(readings, ("event_id",)).select("station_id", "ts", "variable", catalogue._stand_in().alias("ml_score"))
    want = detect.verdicts(detect.judged(r, edges, clim, batch, ("event_id",)))
    shown = lambda x: {(a["station_id"], a["ts"], a["variable"]): (a["status"], a["fault_type"], a["severity"], a["trust"], tuple(a["reasons"]), round(a["scores"]["spatial_z"] or 0, 6)) for a in x.collect()}
    mine, other = shown(got), shown(want)
    assert all(mine[k] == other[k] for k in mine)
    # what is left waits for two hours of all neighbours, at the end of the record
    waits = sorted({k[1] for k in set(other) - set(mine)})
    assert waits[0] > max(k[1] for k in other).replace(hour=0) - timedelta(days=2) and len(mine) > 0.9 * len(other)
    aside = spark.read.parquet(f"file://{tmp_path}/run/late").collect()
    assert {str(a["ts"]) for a in aside} == {"2023-01-01 05:00:00"} and len(aside) == 3


def test_stream_with_its_own_model(spark, net, tmp_path):
    """Scores, features and Shapley values of the stream are those of one plan."""
    r, edges, _ = net
    r = r.where("ts < '2024-01-12'")
    model = detect.Model(r.drop("event_id"), trees=15)
    half = F.col("ts") < "2024-01-07"
    for part in (r.where(half), r.where(~half)):
        part.select("station_id", "ts", "event_id", *VARIABLES).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    got = detect_stream(spark, f"file://{tmp_path}/in", SCHEMA, edges, model.clim, model.score_signals, f"file://{tmp_path}/run", forest=model.forest)
    want = detect.verdicts(detect.judged(r.drop("event_id"), edges, model.clim, model.score), forest=model.forest)
    shown = lambda x: {(a["station_id"], a["ts"], a["variable"]): (a["status"], a["fault_type"], round(a["scores"]["iforest"], 9), [(c["label"], c["contribution"]) for c in a["shap_top"]]) for a in x.collect()}
    mine, other = shown(got), shown(want)
    assert len(mine) > 200 and [(k, v, other[k]) for k, v in mine.items() if v != other[k]] == []
    assert sum(bool(v[3]) for v in mine.values()) > 3
