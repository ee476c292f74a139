"""Known cases of the sensor operators on hand-made rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from brontide.config import VARIABLES
from brontide.functions.scalars import dewpoint_c, haversine_km, severity
from brontide.operators import climatology, evaluate, forest, fusion, geo, heal, history, ingest, inject, physics, spatial, summary
from brontide.operators.features import feature_frame
from brontide.plans import detect
from brontide.sources import readings as src

STATIONS = [("A", "A", 28.60, 77.20, 216), ("B", "B", 28.65, 77.25, 210), ("C", "C", 28.55, 77.10, 230)]


def history_of(spark, values, variable="temp_c"):
    usual = {"temp_c": 30.0, "pressure_hpa": 1013.0, "rh_pct": 60.0}
    rows = [("A", k, *[v if x == variable else usual[x] for x in VARIABLES]) for k, v in enumerate(values)]
    return spark.createDataFrame(rows, "station_id string, k int, temp_c double, pressure_hpa double, rh_pct double").select("station_id", F.timestamp_seconds(1722470400 + F.col("k") * 3600).alias("ts"), *VARIABLES)


def network(spark, hours=480):
    rows = [(s, h, 30 + 5 * math.sin(2 * math.pi * h / 24) + 0.3 * i, 1000 + math.cos(4 * math.pi * h / 24) - 0.2 * i, 60 - 15 * math.sin(2 * math.pi * h / 24) + i) for i, (s, *_) in enumerate(STATIONS) for h in range(hours)]
    return spark.createDataFrame(rows, "station_id string, k int, temp_c double, pressure_hpa double, rh_pct double").select("station_id", F.timestamp_seconds(1722470400 + F.col("k") * 3600).alias("ts"), *VARIABLES)


def stations(spark):
    return spark.createDataFrame(STATIONS, src.STATIONS)


def last_kind(spark, values, variable="temp_c", z=None):
    h = physics.check_physics(physics.rule_flags(history.sensor_history(history_of(spark, values, variable))))
    h = history.usual_spread(history.pattern_columns(h)).withColumn("z", F.lit(z).cast("double"))
    return fusion.fingerprint(h).where(F.col("variable") == variable).orderBy(F.desc("ts")).first()["fault_type"]


NAN = None


@pytest.mark.parametrize(
    ("values", "variable", "kind"),
    [
        ([30.0, 31.0, NAN], "temp_c", "DROPOUT"),
        ([30.0, 31.0, -9999.0], "temp_c", "DROPOUT"),
        ([1013.0, 1012.0, 0.0], "pressure_hpa", "DROPOUT"),
        ([30.0, 31.0, 60.0], "temp_c", "OUT_OF_RANGE"),
        ([50.0, 60.0, 107.0], "rh_pct", "OUT_OF_RANGE"),
        ([30.0, 31.0] + [32.0] * 7, "temp_c", "FROZEN"),
        ([1012.0] * 12, "pressure_hpa", "FROZEN"),
        ([95.0, 98.0] + [100.0] * 6, "rh_pct", None),
        ([30.0, 31.0, 30.5, 45.0, 30.8], "temp_c", "SPIKE"),
        ([30.0, 30.5, 31.0, 30.8, 55.0], "temp_c", "SPIKE"),
        ([30.0 + 0.1 * (k % 3) for k in range(10)] + [55.0, 55.0], "temp_c", "SPIKE"),
        ([30.0, 30.5, 31.0, 30.8, 31.2], "temp_c", None),
        ([30.0], "temp_c", None),
    ],
)
def test_kinds_of_fault(spark, values, variable, kind):
    assert last_kind(spark, values, variable) == kind


def test_drift_needs_neighbours_that_disagree(spark):
    values = [30 + 0.1 * (k % 4) for k in range(24)] + [30 + 0.2 * k for k in range(24)]
    assert [last_kind(spark, values, z=z) for z in (5.0, 1.0, None)] == ["DRIFT", None, None]


def test_decisions(spark):
    rows = [(True, False, None, True, 0.9, 12.0), (False, False, None, False, 0.995, 7.0), (False, True, None, True, 0.995, 5.0), (False, False, None, True, 0.995, 5.0), (False, False, None, None, 0.995, 5.0), (False, False, None, False, 0.96, 4.0), (False, False, None, True, 0.96, 2.0), (False, False, None, False, 0.5, 1.0)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, hard boolean, soft boolean, z double, consistent boolean, ml_score double, dev_sigma double")
    got = [r["status"] for r in fusion.decide(df, 0.99, 0.95).orderBy("k").collect()]
    assert got == ["SENSOR_FAULT", "SENSOR_FAULT", "SENSOR_FAULT", "GENUINE_EVENT", "SUSPECT", "SUSPECT", "NORMAL", "NORMAL"]


def test_scalars(spark):
    r = spark.range(1).select(haversine_km(F.lit(28.61), F.lit(77.21), F.lit(19.08), F.lit(72.88)).alias("km"), dewpoint_c(F.lit(30.0), F.lit(50.0)).alias("d"), dewpoint_c(F.lit(None).cast("double"), F.lit(50.0)).alias("none"), *[severity(F.lit(s)).alias(f"s{k}") for k, s in enumerate((2.9, 3.0, 6.0, -10.0))]).first()
    assert 1100 < r["km"] < 1200 and abs(r["d"] - 18.4) < 0.1 and r["none"] is None
    assert [r[f"s{k}"] for k in range(4)] == ["LOW", "MEDIUM", "HIGH", "CRITICAL"]


def test_neighbours_match_all_pairs(spark):
    import random

    rng = random.Random(3)
    rows = [(f"S{k}", f"S{k}", rng.uniform(-89, 89), rng.choice([rng.uniform(-180, 180), 179.5, -179.5]), 0) for k in range(120)]
    got = {(r[0], r[1]) for r in geo.neighbour_edges(spark.createDataFrame(rows, src.STATIONS), 900.0).collect()}

    def km(a, b):
        p, q = math.radians(a[2]), math.radians(b[2])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[3] - a[3]) / 2) ** 2
        return 2 * 6371.0 * math.asin(math.sqrt(h))

    assert got == {(a[0], b[0]) for a in rows for b in rows if a != b and km(a, b) <= 900.0}


def test_short_gaps_are_filled_and_long_ones_kept(spark):
    values = [None if k in (2, 3, 6, 7, 8) else float(k) for k in range(12)]
    r = history_of(spark, values).where("hour(ts) <> 10")
    got = [x["temp_c"] for x in ingest.interpolate(ingest.hourly_grid(r)).orderBy("ts").collect()]
    assert got == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0, None, None, None, 9.0, 10.0, 11.0]


def test_climatology_floor_and_unknown(spark):
    long = ingest.long_form(network(spark))
    clim = climatology.fit_climatology(long)
    r = clim.where("station_id = 'A' and hour = 6 and variable = 'temp_c'").first()
    assert abs(r["mean"] - 35.0) < 1e-9 and r["std"] == 0.3
    other = long.limit(3).withColumn("station_id", F.lit("Z"))
    assert climatology.with_climatology(other, clim).where("anomaly is not null").count() == 0


def test_trust_stays_within_bounds(spark):
    rows = [("A", "temp_c", k, "SENSOR_FAULT" if k < 7 else "NORMAL", "CRITICAL") for k in range(10)]
    df = spark.createDataFrame(rows, "station_id string, variable string, k int, status string, severity string").withColumn("ts", F.timestamp_seconds(F.col("k") * 3600))
    assert [r["trust"] for r in heal.trust_scores(df).orderBy("k").collect()] == [80.0, 60.0, 40.0, 20.0, 0.0, 0.0, 0.0, 0.5, 1.0, 1.5]


def test_whole_detector_finds_an_injected_spike_and_a_frozen_sensor(spark):
    clean = network(spark)
    events = spark.createDataFrame([("SPIKE_001", "A", "temp_c", "SPIKE", 1, 15.0, 1723000000 // 3600 * 3600), ("FROZEN_001", "B", "pressure_hpa", "FROZEN", 30, 0.0, 1723200000 // 3600 * 3600)], "event_id string, station_id string, variable string, fault string, hours int, magnitude double, at long").withColumn("start", F.timestamp_seconds("at")).drop("at")
    labelled = inject.inject_faults(inject.add_labels(clean), events)
    result = detect.detect(labelled.select("station_id", "ts", *VARIABLES), stations(spark), clean, trees=20)
    caught = evaluate.align(result, labelled).where("label <> 'NONE' and status in ('SENSOR_FAULT', 'SUSPECT')").groupBy("label").count().collect()
    assert {r[0]: r[1] for r in caught}.keys() == {"SPIKE", "FROZEN"}
    assert result.where("status <> 'NORMAL' and size(reasons) = 0").count() == 0
    scores = evaluate.fault_scores(evaluate.align(result, labelled)).where("fault_type = 'SPIKE'").first()
    assert scores["tp"] == 1 and scores["fn"] == 0


def test_preview_reads_labels(spark):
    labelled = inject.inject_storm(inject.add_labels(network(spark, 48)), stations(spark), "A", "2024-08-01 10:00:00")
    got = {r[0]: r[1] for r in detect.preview(labelled, geo.neighbour_edges(stations(spark))).groupBy("status").count().collect()}
    assert got["GENUINE_EVENT"] > 0 and got.get("SENSOR_FAULT", 0) == 0


def test_unknown_fault_is_refused(spark):
    events = spark.createDataFrame([("X", "A", "temp_c", "MELTED", 1, 0.0)], "event_id string, station_id string, variable string, fault string, hours int, magnitude double").withColumn("start", F.current_timestamp())
    with pytest.raises(Exception, match="unknown kind of fault: MELTED"):
        inject.inject_faults(inject.add_labels(network(spark, 5)), events).collect()


def test_planned_events_leave_gaps():
    places = [(s, lat, lon) for s, _, lat, lon, _ in STATIONS]
    storms, faults = inject.plan_test_set(places, 0, 5000, per_fault=5, storms=4)
    assert len(storms) == 4 and len(faults) > 20 and all(r[7] == (r[2] == "rh_pct" and r[3] == "SPIKE") for r in faults)
    for s in ("A", "B", "C"):
        # all stations lie within a storm's reach, and it takes at most eleven hours
        own = sorted([(r[4] // 3600, r[4] // 3600 + r[5]) for r in faults if r[1] == s] + [(r[2] // 3600, r[2] // 3600 + 11) for r in storms])
        assert all(b + 6 <= c for (_, b), (c, _) in zip(own, own[1:], strict=False))


def test_test_set_holds_storms_and_faults(spark):
    out = inject.build_test_set(network(spark, 900), stations(spark), per_fault=1, storms=2)
    by = {r[0]: r[1] for r in out.groupBy("event_id").count().collect()}
    assert {"STORM_001", "STORM_002"} < by.keys() and sum(k.startswith(("STORM", "")) for k in by) == len(by) and out.count() == 2700
    assert out.where("event_id like 'STORM%' and label_temp_c <> 'NONE'").count() == 0
    calm = out.join(network(spark, 900).select("station_id", "ts", F.col("temp_c").alias("t")), ["station_id", "ts"])
    assert calm.where("event_id = '' and temp_c <> t").count() == 0 and calm.where("event_id like 'STORM%' and temp_c >= t").count() == 0


def test_noise_is_scaled_by_the_usual_step(spark):
    rows = [("A", k, 20.0 + 3 * (k % 2), 1000.0, 50.0) for k in range(600)]
    r = spark.createDataFrame(rows, "station_id string, k int, temp_c double, pressure_hpa double, rh_pct double").select("station_id", F.timestamp_seconds(F.col("k") * 3600).alias("ts"), *VARIABLES)
    events = spark.createDataFrame([("N", "A", "temp_c", "NOISE", 600, 2.0)], "event_id string, station_id string, variable string, fault string, hours int, magnitude double").withColumn("start", F.timestamp_seconds(F.lit(0)))
    out = inject.inject_faults(inject.add_labels(r), events)
    d = out.agg(F.stddev_samp(F.col("temp_c") - F.col("orig_temp_c")), F.avg(F.col("temp_c") - F.col("orig_temp_c"))).first()
    assert 5.3 < d[0] < 6.7 and abs(d[1]) < 0.8  # steps of 3 up and down deviate by 3
    assert [x["temp_c"] for x in out.orderBy("ts").collect()] == [x["temp_c"] for x in inject.inject_faults(inject.add_labels(r.repartition(7)), events).orderBy("ts").collect()]


def test_remote_stations_have_links_too(spark):
    rows = [*STATIONS, ("X", "X", -33.9, 151.2, 10), ("Y", "Y", 64.1, -21.9, 10)]
    got = {(r["a"], r["b"]) for r in geo.nearest_links(spark.createDataFrame(rows, src.STATIONS), 2).collect()}
    km = lambda p, q: math.acos(min(1.0, math.sin(math.radians(p[2])) * math.sin(math.radians(q[2])) + math.cos(math.radians(p[2])) * math.cos(math.radians(q[2])) * math.cos(math.radians(p[3] - q[3]))))
    want = {tuple(sorted((p[0], q[0]))) for p in rows for q in sorted((q for q in rows if q is not p), key=lambda q: km(p, q))[:2]}
    assert got == want
    alone = spark.createDataFrame(rows[:1], src.STATIONS)
    assert geo.nearest_links(alone).count() == 0 and geo.nearest_links(alone.limit(0)).count() == 0


def test_neighbours_in_one_pass_say_what_they_say_apart(spark):
    r = network(spark, 60).where("not (station_id = 'B' and hour(ts) % 7 = 0)")
    a = climatology.with_climatology(ingest.long_form(r), climatology.fit_climatology(ingest.long_form(network(spark))))
    near = spatial.around(a, geo.neighbour_edges(stations(spark)))
    keys = ["station_id", "ts", "variable"]
    both = spatial.neighbour_signals(a, near).orderBy(*keys)
    apart = spatial.neighbour_anomaly(a, near).join(spatial.spatial_check(a, near), keys, "left").withColumn("n", F.coalesce("n", F.lit(0))).select(*both.columns).orderBy(*keys)
    assert both.collect() == apart.collect()


@pytest.mark.parametrize("buckets", [1, 7, 4096])
def test_percentile_ranks_match_counting(spark, buckets):
    rng = random.Random(buckets)
    values = [round(rng.uniform(-0.2, 1.3), 2) for _ in range(300)]
    cal = spark.createDataFrame([(v, s) for v in ("a", "b") for s in values], "variable string, score double")
    asked = [round(rng.uniform(-0.4, 1.5), 2) for _ in range(80)]
    rows = spark.createDataFrame([(rng.choice("ab"), x, k) for k, x in enumerate(asked)], "variable string, raw double, k int")
    for side in ("left", "right"):
        got = {r["k"]: r["ml_score"] for r in forest.percentile_rank(rows, cal, buckets, side).collect()}
        assert got == {k: sum(s < x or side == "right" and s == x for s in values) / 300 for k, x in enumerate(asked)}


def test_calibration_counts_every_row(spark):
    r = network(spark, 100)
    f = feature_frame(r, climatology.fit_climatology(ingest.long_form(r)))
    model = forest.Forest(forest.fit_forest(f, trees=10))
    known = forest.calibrate(f, model)
    assert {v: int(k[1].sum()) for v, k in known.items()} == dict.fromkeys(VARIABLES, 300)
    raw = {v: sorted(round(x["raw"], forest.DIGITS) for x in forest.score_forest(f, model).where(F.col("variable") == v).collect()) for v in VARIABLES}
    for x in forest.score_forest(f, model, known).sample(0.2, 1).collect():
        assert abs(x["ml_score"] - sum(s <= round(x["raw"], forest.DIGITS) for s in raw[x["variable"]]) / 300) < 1e-9


def test_metrics_file_and_sample(spark, tmp_path):
    (tmp_path / "metrics.json").write_text('{"per_fault": {"SPIKE": {"precision": 0.9, "recall": 0.8, "f1": 0.85, "events": 10}}, "false_alarm_rate_normal": 0.01, "false_alarm_rate_storm": null, "fault_type_accuracy": null, "impute_mae": {"temp_c": 0.5}, "latency_ms_mean": 4.0}')
    m = src.scan_metrics(spark, f"file://{tmp_path}/metrics.json")
    assert m.first()["per_fault"]["SPIKE"]["f1"] == 0.85
    tiles = {r["name"]: r["text"] for r in evaluate.scorecard_tiles(m, m).collect()}
    assert tiles == {"False alarms during storms": "-", "False alarms, normal weather": "1.0%", "Fault type named correctly": "-", "Mean check time": "4 ms"}
    s = src.sample_of(network(spark, 900), 2, 31)
    assert {r[0] for r in s.select("station_id").distinct().collect()} == {"A", "B"} and s.count() == 2 * 31 * 24


def test_forest_round_trip_and_order(spark, tmp_path):
    r = network(spark, 240)
    f = feature_frame(r, climatology.fit_climatology(ingest.long_form(r)))
    nodes = forest.fit_forest(f, trees=100)
    model = forest.Forest(nodes)
    known = forest.calibrate(f, model)
    forest.save_model(nodes, known, f"file://{tmp_path}/model")
    again, known2 = forest.load_model(spark, f"file://{tmp_path}/model")
    odd = f.where("variable = 'temp_c'").limit(50).withColumn("value", F.lit(90.0)).withColumn("diff_1", F.lit(60.0)).withColumn("dev_sigma", F.lit(150.0))
    a = forest.score_forest(odd, model, known).agg(F.avg("ml_score")).first()[0]
    b = forest.score_forest(odd, again, known2).agg(F.avg("ml_score")).first()[0]
    assert a == b and a > 0.9


def test_landing_and_exports(spark, tmp_path):
    r = network(spark, 30).withColumn("temp_c", F.when((F.col("station_id") != "C") | (F.hour("ts") < 5), F.col("temp_c")))
    src.land(r, f"file://{tmp_path}/raw")
    assert {x[0] for x in spark.read.parquet(f"file://{tmp_path}/raw").select("station_id").distinct().collect()} == {"A", "B"}
    src.export_csv(r.limit(2).select("station_id", "temp_c"), f"file://{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/csv").count() == 2
    body = '{"hourly": {"time": ["2024-01-01T00:00", "2024-01-01T01:00"], "temperature_2m": [1.5, null], "pressure_msl": [1000.0, 1001.0], "relative_humidity_2m": [50.0, 51.0]}}'
    got = src.hourly_payload(spark.createDataFrame([("A", body)], "station_id string, body string")).orderBy("ts").collect()
    assert [x["temp_c"] for x in got] == [1.5, None]


def test_empty_results_give_empty_summaries(spark):
    none = spark.createDataFrame([], "station_id string, ts timestamp, variable string, value double, status string, fault_type string, severity string, confidence double, corrected_value double, trust double")
    assert summary.alerts(none).count() == 0
