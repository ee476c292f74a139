"""The archive source against a server on this machine, what it lands, and the tables written beside it."""

import json
import threading
from datetime import date, timedelta
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from brontide.operators import inject, overlay
from brontide.plans import catalogue
from brontide.sources import archive
from brontide.sources import readings as src

DATA = "/root/testdata/sf0.001"
STATIONS = [{"station_id": s, "name": s, "lat": lat, "lon": 77.0} for s, lat in (("A", 28.0), ("B", 29.0), ("C", 30.0), ("D", 31.0))]


class Service(BaseHTTPRequestHandler):
    """A: all there. B: fails once a year, then answers. C: never answers. D: mostly nulls."""

    asked: list = []
    failed: set = set()

    def do_GET(self):
        q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
        Service.asked.append((q["latitude"], q["start_date"], q["end_date"]))
        key = (q["latitude"], q["start_date"])
        if q["latitude"] == "30.0" or (q["latitude"] == "29.0" and key not in Service.failed):
            Service.failed.add(key)
            self.send_error(503)
            return
        first, last = (date.fromisoformat(q[k]) for k in ("start_date", "end_date"))
        times = [f"{first + timedelta(days=d)}T{h:02d}:00" for d in range((last - first).days + 1) for h in (0, 12)]
        value = lambda k: None if q["latitude"] == "31.0" and k % 3 else float(k)
        body = {"hourly": {"time": times} | {f: [value(k) for k in range(len(times))] for f in q["hourly"].split(",")}}
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps(body).encode())

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def url():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/v1/archive"
    server.shutdown()


def test_years():
    assert archive.years("2022-03-05", "2024-02-01") == [("2022-03-05", "2022-12-31"), ("2023-01-01", "2023-12-31"), ("2024-01-01", "2024-02-01")]


def test_stations_by_year_with_retries_and_landing(spark, url, tmp_path):
    got = archive.fetch(spark, url, STATIONS, "2022-12-30", "2023-01-02", pause=0.01).cache()
    assert got.schema.simpleString() == spark.createDataFrame([], src.READINGS).schema.simpleString()
    assert {r["station_id"]: r["count"] for r in got.groupBy("station_id").count().collect()} == {"A": 8, "B": 8, "D": 8}
    assert {(a, b) for lat, a, b in Service.asked if lat == "28.0"} == {("2022-12-30", "2022-12-31"), ("2023-01-01", "2023-01-02")}
    assert str(got.where("station_id = 'A'").agg(F.min("ts")).first()[0]) == "2022-12-30 00:00:00"
    src.land(got, f"file://{tmp_path}/raw")
    assert {r[0] for r in spark.read.parquet(f"file://{tmp_path}/raw").select("station_id").distinct().collect()} == {"A", "B"}


def test_times_are_utc_whatever_the_zone(spark, url):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
        got = archive.fetch(spark, url, STATIONS[:1], "2023-01-01", "2023-01-01", pause=0.01).select(F.unix_timestamp("ts")).collect()
        body = json.dumps({"hourly": {"time": ["2023-01-01T00:00", "2023-01-01T12:00"]} | {f: [1.0, 2.0] for f in archive.FIELDS.values()}})
        landed = src.hourly_payload(spark.createDataFrame([("A", body)], "station_id string, body string")).select(F.unix_timestamp("ts")).collect()
        with pytest.raises(ValueError, match="must be UTC"):
            src.scan_readings(spark, "file:///nowhere")
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert sorted(r[0] for r in got) == sorted(r[0] for r in landed) == [1672531200, 1672574400]


def test_failure_may_fail(spark, url):
    with pytest.raises(Exception, match="503"):
        archive.fetch(spark, url, STATIONS[2:3], "2023-01-01", "2023-01-01", pause=0.01, onFailure="fail").collect()


def test_test_sets_and_scores_are_written(spark, tmp_path):
    r = inject.add_labels(catalogue._readings(spark, DATA).drop("event_id"))
    src.save_test_set(r, f"file://{tmp_path}/set")
    again = src.scan_test_set(spark, f"file://{tmp_path}/set")
    assert set(again.columns) == set(r.columns) and again.select(r.columns).exceptAll(r).count() == 0 and again.count() == r.count()
    scores = spark.createDataFrame([("A", "2024-01-01", "temp_c", 0.5, 0.9), ("A", "2024-01-02", "rh_pct", 0.4, 0.1)], "station_id string, ts string, variable string, raw double, ml_score double")
    src.save_scores(scores, f"file://{tmp_path}/scores")
    assert spark.read.parquet(f"file://{tmp_path}/scores").where("variable = 'temp_c'").count() == 1


def test_overlay(spark):
    lay = overlay.Overlay(catalogue._readings(spark, DATA).drop("event_id"), catalogue._stations(spark, DATA))
    end = lay.clean.agg(F.max("ts")).first()[0]
    assert lay.next_hour("2030-01-01") == end
    t = lay.next_hour("2024-01-08 00:00:00")
    at = lambda s: lay.readings().where((F.col("station_id") == s) & (F.col("ts") == F.lit(t))).first()
    station = lay.clean.where((F.col("ts") == F.lit(t)) & F.col("temp_c").isNotNull()).first()["station_id"]
    assert lay.inject_spike("2024-01-08 00:00:00", station) == t and at(station)["temp_c"] == 55.0 and at(station)["event_id"] == "SPIKE_001"
    assert lay.inject_spike("2024-01-08 00:00:00", station, 40.0) == t and at(station)["temp_c"] == 40.0 and at(station)["event_id"] == "SPIKE_002"
    assert lay.inject_storm("2024-01-08 00:00:00", station) == t and lay.inject_storm("2024-01-08 05:00:00", station) is None
    assert at(station)["event_id"] == "STORM_001" and at(station)["label_temp_c"] == "SPIKE"
    lay.clear()
    assert lay.readings().exceptAll(lay.clean).count() == 0
    assert lay.inject_storm("2024-01-08 05:00:00", station) is not None
