"""Neighbours where many stations stand at one place, near poles and with odd names, against plain loops."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from brontide.operators import geo
from brontide.plans import catalogue
from brontide.sources import readings as src


def km(p, q):
    h = math.sin(math.radians(q[2] - p[2]) / 2) ** 2 + math.cos(math.radians(p[2])) * math.cos(math.radians(q[2])) * math.sin(math.radians(q[3] - p[3]) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(h))


def ranked(rows):
    """(name, neighbour, place), names that come more than once included."""
    out = []
    for name in {r[0] for r in rows if r[0]}:
        near = sorted((km(p, q), q[0]) for p in rows if p[0] == name for q in rows if q[0] and q[0] != name)
        out += [(name, q, k) for k, (_, q) in enumerate(near, 1)]
    return out


def links(rows, k):
    return {tuple(sorted(p[:2])) for p in ranked(rows) if p[2] <= k}


def crowded(spark, n, places):
    k = F.col("id") % places
    return spark.range(n).select(F.concat(F.lit("ST-"), F.col("id")).alias("station_id"), F.lit("").alias("name"), (28 + k / 8).alias("lat"), (77 + k / 8).alias("lon"), F.lit(0).alias("elevation_m"))


def odd_rows(repeat):
    rng = random.Random(5)
    spots = [(rng.uniform(28, 28.3), rng.uniform(77, 77.3)) for _ in range(12)] + [(0.0, 179.999), (0.0, -179.999)]
    rows = [(f"S{k}", "", *rng.choice(spots), 0) for k in range(90)] + [("far", "", -60.0, 10.0, 0), (None, "", *spots[0], 0)]
    return rows + ([rows[3], rows[3], ("S5", "", -10.0, 10.0, 0)] if repeat else [])


@pytest.mark.parametrize("repeat, radius", [(False, 1.0), (True, 150.0)])
def test_links_of_crowded_places(spark, repeat, radius):
    rows = odd_rows(repeat)
    assert {(r["a"], r["b"]) for r in geo.nearest_links(spark.createDataFrame(rows, src.STATIONS), 3, radius).collect()} == links(rows, 3)


@pytest.mark.parametrize("n", [1, 2, 4])
def test_links_of_few_stations(spark, n):
    rows = [(f"S{k}", "", 28.0, 77.0, 0) for k in range(n)]
    assert {(r["a"], r["b"]) for r in geo.nearest_links(spark.createDataFrame(rows, src.STATIONS), 3).collect()} == links(rows, 3)


def test_links_start_with_less_than_the_radius_where_stations_are_dense(spark):
    rng = random.Random(9)
    rows = [(f"S{k}", "", rng.uniform(28, 28.4), rng.uniform(77, 77.4), 0) for k in range(1200)] + [(f"F{k}", "", -20.0 - k, 10.0, 0) for k in range(3)]
    stations = spark.createDataFrame(rows, src.STATIONS)
    assert geo._first_radius(stations, 150.0, 20) < 10
    want = {tuple(sorted((p[0], q[1]))) for p in rows for q in sorted((km(p, q), q[0]) for q in rows if q is not p)[:3]}
    assert {(r["a"], r["b"]) for r in geo.nearest_links(stations).collect()} == want


def test_links_of_crowded_places_make_no_pairs_of_all(spark):
    began = time.time()
    assert geo.nearest_links(crowded(spark, 60000, 16)).count() == 16 * (6 + 3 * 3746)
    assert time.time() - began < 90  # all pairs, 3.6 billion, take many minutes


def test_neighbours_around_a_pole(spark):
    rows = [(f"P{k}", "", lat, lon, 0) for k, (lat, lon) in enumerate((s * lat, lon) for s in (1, -1) for lat in (89.98, 89.95, 90.0) for lon in (-170.0, -60.0, 0.0, 10.0, 120.0))]
    got = {(r[0], r[1]) for r in geo.neighbour_edges(spark.createDataFrame(rows, src.STATIONS), 5.0).collect()}
    assert got == {(p[0], q[0]) for p in rows for q in rows if p is not q and km(p, q) <= 5.0}


def test_edges_of_crowded_places(spark):
    began, n = time.time(), 6000
    edges = geo.neighbour_edges(crowded(spark, 4 * n, 4), 20.0)
    got = edges.groupBy("distance_km", F.spark_partition_id().alias("task")).count().collect()
    sums = {d: sum(r["count"] for r in got if r[0] == d) for d in {r[0] for r in got}}
    assert sums == {0.0: 4 * n * (n - 1), round(km((0, 0, 28, 77), (0, 0, 28.125, 77.125)), 1): 6 * n * n}
    # few short rows are dealt before they become many, so tasks share the pairs
    tasks = [sum(r["count"] for r in got if r["task"] == t) for t in {r["task"] for r in got}]
    assert len(tasks) == 4 and max(tasks) < 2 * sum(tasks) / 4
    assert time.time() - began < 60  # a distance for each of 576 million pairs takes longer


def test_blocks_of_crowded_cells_are_small_and_in_order_of_places(spark):
    posted = crowded(spark, 12000, 3).select("station_id", "lat", "lon", F.lit(0).alias("b"), F.lit(0).alias("c"))
    blocks = [[(p["lat"], p["lon"], p["ids"]) for p in r["home"]] for r in geo._blocks(posted, "home").collect()]
    # a task holds all pairs of two blocks at once: a million of them kept it busy collecting garbage
    assert max(sum(len(p[2]) for p in b) for b in blocks) <= 256
    assert sum(map(len, blocks)) <= len(blocks) + 2  # blocks cut places, and don't mix them
    assert sorted(s for b in blocks for p in b for s in p[2]) == sorted(f"ST-{k}" for k in range(12000))
    assert all((float(s[3:]) % 3) / 8 == p[0] - 28 for b in blocks for p in b for s in p[2])


@pytest.mark.parametrize("block", [1, 7])
def test_edges_of_odd_rows_in_blocks_that_cut_places(spark, monkeypatch, block):
    monkeypatch.setattr(geo, "BLOCK", block)
    rows = odd_rows(True)
    want = sorted((p[0], q[0], round(km(p, q), 1)) for p in rows for q in rows if p[0] and q[0] and p[0] != q[0] and km(p, q) <= 20.0)
    assert sorted(tuple(r) for r in geo.neighbour_edges(spark.createDataFrame(rows, src.STATIONS), 20.0).collect()) == want


@pytest.mark.parametrize("repeat", [False, True])
def test_edges_and_rankings_of_odd_rows(spark, repeat):
    rows = odd_rows(repeat)
    stations = spark.createDataFrame(rows, src.STATIONS)
    want = sorted((p[0], q[0], round(km(p, q), 1)) for p in rows for q in rows if p[0] and q[0] and p[0] != q[0] and km(p, q) <= 20.0)
    assert sorted(tuple(r) for r in geo.neighbour_edges(stations, 20.0).collect()) == want
    ranking = sorted(tuple(r) for r in geo.neighbours_ranked(stations, 20.0, 1).select("station_id", "neighbour_id", "place").collect())
    near = [(name, sorted((km(p, q), q[0]) for p in rows if p[0] == name for q in rows if q[0] and q[0] != name and km(p, q) <= 20.0)) for name in {r[0] for r in rows if r[0]}]
    assert ranking == sorted((name, q, n) for name, of in near for n, (_, q) in enumerate(of, 1))


def test_ranking_of_crowded_places(spark, tmp_path):
    began, n = time.time(), 20000
    spark.range(n).select(F.col("id").alias("s_suppkey"), F.lit("").alias("s_name")).write.parquet(f"{tmp_path}/supplier.parquet")
    at = [(0, 0, 28 + (k * 37 % 64) / 128, 77 + (k * 11 % 64) / 128) for k in range(64)]
    here = [n // 64 + (k < n % 64) for k in range(64)]
    near = [sum(here[j] for j in range(64) if km(at[k], at[j]) <= 20.0) - 1 for k in range(64)]
    r = catalogue.q_neighbours_ranked(spark, str(tmp_path)).agg(F.count("*"), F.sum("place")).first()
    assert tuple(r) == (sum(h * m for h, m in zip(here, near, strict=True)), sum(h * m * (m + 1) // 2 for h, m in zip(here, near, strict=True)))
    assert time.time() - began < 60  # sorting all pairs takes longer


@pytest.mark.parametrize("tile", [1, 7])
def test_rankings_of_odd_rows_in_tiles(spark, monkeypatch, tile):
    monkeypatch.setattr(geo, "TILE", tile)
    rows = odd_rows(True)
    near = [(name, sorted((km(p, q), q[0]) for p in rows if p[0] == name for q in rows if q[0] and q[0] != name and km(p, q) <= 20.0)) for name in {r[0] for r in rows if r[0]}]
    want = sorted((name, q, round(d, 1), n) for name, of in near for n, (d, q) in enumerate(of, 1))
    assert sorted(tuple(r) for r in geo.neighbours_ranked(spark.createDataFrame(rows, src.STATIONS), 20.0, 1).select("station_id", "neighbour_id", "distance_km", "place").collect()) == want


def shuffled(spark, group):
    """Bytes that the tasks of each stage of a job group gave to a shuffle."""
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    tracker, store = spark.sparkContext.statusTracker(), spark._jsc.sc().statusStore()
    for stage in {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}:
        tasks = store.taskList(stage, 0, 1000)
        yield [tasks.apply(k).taskMetrics().get().shuffleWriteMetrics().bytesWritten() for k in range(tasks.size())]


def test_ranking_of_one_crowded_place_is_shared_by_tasks(spark):
    n = 12000
    spark.sparkContext.setJobGroup("one place", "")
    try:
        r = geo.neighbours_ranked(crowded(spark, n, 1), 20.0, 1).agg(F.count("*"), F.sum("place"), F.sum("distance_km")).first()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert tuple(r) == (n * (n - 1), n * n * (n - 1) // 2, 0.0)
    # what meets grows with the square of a place's stations, so one task must not deal it
    stages = [x for x in shuffled(spark, "one place") if sum(x) > 1e6]
    assert stages and all(max(x) < sum(x) / 2 for x in stages), stages
