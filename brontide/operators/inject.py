"""Labelled faults and storms: an events table, joined to the readings by station and hour."""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brontide.config import CONFIG, FAULTS, VARIABLES
from brontide.functions.scalars import in_range, km_between
from brontide.operators.geo import neighbour_edges

EVENTS = "event_id string, station_id string, variable string, fault string, start timestamp, hours int, magnitude double"


def add_labels(readings: DataFrame) -> DataFrame:
    """The label columns, each only where it is missing."""
    new = {f"orig_{v}": F.col(v).cast("double") for v in VARIABLES} | {f"label_{v}": F.lit("NONE") for v in VARIABLES} | {"event_id": F.lit("")}
    return readings.withColumns({k: c for k, c in new.items() if k not in readings.columns})


def _uniform(key, start: int):
    """A number in (0, 1) from eight hexadecimal digits of the key's MD5."""
    return (F.conv(F.substring(F.md5(key), start, 8), 16, 10).cast("double") + 1) / 4294967298.0


def normal_draw(*parts):
    """A standard normal number for each combination of the parts, whatever the order of rows."""
    key = F.concat_ws("|", *parts)
    return F.sqrt(-2 * F.log(_uniform(key, 1))) * F.cos(2 * math.pi * _uniform(key, 9))


def usual_step(labelled: DataFrame, variable: str) -> DataFrame:
    """station_id, step: the deviation of the differences between one clean reading in range and the next."""
    clean = labelled.where(F.col(f"label_{variable}") == "NONE").select("station_id", "ts", F.when(in_range(F.col(variable), F.lit(variable)), F.col(variable)).alias("v"))
    w = Window.partitionBy("station_id").orderBy("ts")
    return clean.withColumn("d", F.col("v") - F.lag("v").over(w)).groupBy("station_id").agg(F.stddev_samp("d").alias("step"))


def inject_faults(labelled: DataFrame, events: DataFrame) -> DataFrame:
    """labelled (READINGS and label columns) with the events applied; an hour takes the first event by event_id.

    magnitude: the jump, ramp end, stuck value (OUT_OF_RANGE), dropout value (null for null), or for NOISE a multiple of the
    station's usual step. Where events have a column free_sign, a jump in humidity that is free goes to the side with room.

    New values are worked out on the events' own hours, all variables together, and joined to the readings once.
    """
    if "free_sign" not in events.columns:
        events = events.withColumn("free_sign", F.lit(False))
    known = F.when(F.col("fault").isin(*FAULTS), F.col("fault")).otherwise(F.raise_error(F.concat(F.lit("unknown kind of fault: "), F.col("fault"))).cast("string"))
    hours = events.withColumn("fault", known).withColumn("ts", F.explode(F.sequence(F.col("start"), F.timestamp_seconds(F.unix_timestamp("start") + (F.col("hours") - 1) * 3600), F.expr("interval 1 hour"))))
    hours = hours.groupBy("station_id", "ts", "variable").agg(F.min(F.struct("event_id", "fault", "magnitude", "free_sign")).alias("e"))
    steps = None
    for v in VARIABLES:
        noisy = events.where((F.col("variable") == v) & (F.col("fault") == "NOISE")).select("station_id").distinct()
        own = usual_step(labelled.join(noisy, "station_id", "left_semi"), v).withColumn("variable", F.lit(v))
        steps = own if steps is None else steps.unionByName(own)
    now = F.coalesce(*[F.when(F.col("variable") == v, F.col(v)) for v in VARIABLES])
    x = hours.join(labelled.select("station_id", "ts", *VARIABLES), ["station_id", "ts"]).withColumn("x", now).join(steps, ["station_id", "variable"], "left")
    w = Window.partitionBy("station_id", "variable", "e.event_id").orderBy("ts")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n, k, m, fault = F.count("*").over(whole), F.row_number().over(w) - 1, F.col("e.magnitude"), F.col("e.fault")
    rh = F.col("variable") == "rh_pct"
    jump = F.when(rh & F.col("e.free_sign"), F.when(F.avg("x").over(whole) > 50, -F.abs(m)).otherwise(F.abs(m))).otherwise(m)
    value = (
        F.when(fault == "SPIKE", F.col("x") + jump)
        .when(fault == "FROZEN", F.first("x", True).over(whole))
        .when(fault == "DRIFT", F.col("x") + F.when(n > 1, m * k / (n - 1)).otherwise(m))
        .when(fault == "NOISE", F.col("x") + m * F.col("step") * normal_draw(F.col("e.event_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss")))
        .when(fault.isin("DROPOUT", "OUT_OF_RANGE"), m)
    )
    x = x.withColumn("new", value)
    x = x.withColumn("new", F.when(rh & fault.isin("SPIKE", "DRIFT", "NOISE"), F.greatest(F.least("new", F.lit(100.0)), F.lit(0.0))).otherwise(F.col("new")))
    told = x.groupBy("station_id", "ts").agg(*[F.max(F.when(F.col("variable") == v, F.struct(F.col("e.event_id").alias("event_id"), F.col("e.fault").alias("fault"), "new"))).alias(f"_{v}") for v in VARIABLES])
    hit = {v: F.col(f"_{v}").isNotNull() for v in VARIABLES}
    return labelled.join(told, ["station_id", "ts"], "left").withColumns(
        {v: F.when(hit[v], F.col(f"_{v}.new")).otherwise(F.col(v)) for v in VARIABLES}
        | {f"label_{v}": F.coalesce(F.col(f"_{v}.fault"), F.col(f"label_{v}")) for v in VARIABLES}
        # of faults of several variables in an hour the last one names it
        | {"event_id": F.coalesce(*[F.col(f"_{v}.event_id") for v in reversed(VARIABLES)], F.col("event_id"))}
    ).drop(*[f"_{v}" for v in VARIABLES])


STORMS = "event_id string, center string, start timestamp, strength double, onset_h int, temp_drop double, rh_rise double, pressure_rise double"


def inject_storms(labelled: DataFrame, stations: DataFrame, storms: DataFrame) -> DataFrame:
    """Fronts (STORMS) that leave their centers: stations within the radius are reached in order of distance; labels stay NONE.

    An hour of a station that several storms reach takes all of them, and the name of the last by event_id.
    """
    s = CONFIG["storm"]
    k = F.col("k")
    # stations within the radius are found by cells, so nothing is crossed or broadcast
    centers = storms.select(F.col("center").alias("station_id")).distinct()
    away = neighbour_edges(stations, s["radius_km"], digits=None, seekers=centers).select(F.col("station_id").alias("center"), F.col("neighbour_id").alias("station_id"), F.col("distance_km").alias("km"))
    own = stations.join(centers, "station_id", "left_semi").select(F.col("station_id").alias("center"), "station_id", F.lit(0.0).alias("km"))
    hit = storms.join(away.unionByName(own), "center")
    begin = F.unix_timestamp("start") + F.round(F.col("km") / s["speed_kmh"]) * 3600
    wave = hit.withColumn("b", begin).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("onset_h") + (s["relax_h"] - 1))))
    share = F.col("strength") * F.when(k < F.col("onset_h"), (k + 1) / F.col("onset_h")).otherwise(F.exp(-(k - F.col("onset_h")) / s["tau_h"]))
    wave = wave.select("station_id", F.timestamp_seconds(F.col("b") + k * 3600).alias("ts"), F.col("event_id").alias("_storm"), *[(share * F.col(c)).alias(f"_{c}") for c in ("temp_drop", "rh_rise", "pressure_rise")])
    wave = wave.groupBy("station_id", "ts").agg(F.max("_storm").alias("_storm"), *[F.sum(f"_{c}").alias(f"_{c}") for c in ("temp_drop", "rh_rise", "pressure_rise")])
    out = labelled.join(wave, ["station_id", "ts"], "left")
    hit = F.col("_storm").isNotNull()
    rh = F.greatest(F.least(F.col("rh_pct") + F.col("_rh_rise"), F.lit(100.0)), F.lit(0.0))
    return out.withColumns({
        "temp_c": F.when(hit, F.col("temp_c") - F.col("_temp_drop")).otherwise(F.col("temp_c")),
        "pressure_hpa": F.when(hit, F.col("pressure_hpa") + F.col("_pressure_rise")).otherwise(F.col("pressure_hpa")),
        "rh_pct": F.when(hit, rh).otherwise(F.col("rh_pct")),
        "event_id": F.coalesce("_storm", "event_id"),
    }).drop("_storm", "_temp_drop", "_rh_rise", "_pressure_rise")


def inject_storm(labelled: DataFrame, stations: DataFrame, center: str, start, event_id: str = "STORM_001", strength: float = 1.0) -> DataFrame:
    """One front of the usual size."""
    s = CONFIG["storm"]
    rows = [(event_id, center, strength, s["onset_h"], s["temp_drop"], s["rh_rise"], s["pressure_rise"])]
    storm = labelled.sparkSession.createDataFrame(rows, "event_id string, center string, strength double, onset_h int, temp_drop double, rh_rise double, pressure_rise double")
    return inject_storms(labelled, stations, storm.withColumn("start", F.lit(start).cast("timestamp")))


DURATION = {"SPIKE": (1, 2), "FROZEN": (6, 48), "DRIFT": (72, 240), "DROPOUT": (1, 12), "NOISE": (6, 24), "OUT_OF_RANGE": (6, 48)}
SIZE = {"SPIKE": {"temp_c": (5, 25), "pressure_hpa": (5, 40), "rh_pct": (20, 50)}, "DRIFT": {"temp_c": (2, 5), "pressure_hpa": (2, 6), "rh_pct": (8, 20)}}


#: From and to, for the storms of a test set.
STORM_SIZE = {"strength": (0.7, 1.3), "onset_h": (1, 2), "temp_drop": (4, 10), "rh_rise": (15, 35), "pressure_rise": (1, 4)}


def plan_test_set(stations: list[tuple[str, float, float]], first_hour: int, hours: int, per_fault: int = 40, storms: int = 10, seed: int = CONFIG["seed"], gap: int = 6, tries: int = 200) -> tuple[list[tuple], list[tuple]]:
    """Storms, then faults, for stations (name, lat, lon): rows of STORMS and of EVENTS with free_sign, their starts as seconds.

    Kinds come in turn, at random places that leave ``gap`` clear hours around every event of a station; a storm keeps
    its hours free at every station that it reaches.
    """
    rng = random.Random(seed)
    taken: dict[str, list[tuple[int, int]]] = {s[0]: [] for s in stations}
    names = [s[0] for s in stations]

    def placed(length: int, choose) -> tuple[list[str], int] | None:
        for _ in range(tries):
            own, at = choose(), rng.randrange(max(1, hours - length))
            if all(at + length + gap <= a or b + gap <= at for s in own for a, b in taken[s]):
                for s in own:
                    taken[s].append((at, at + length))
                return own, at
        return None

    s = CONFIG["storm"]
    length = STORM_SIZE["onset_h"][1] + s["relax_h"] + math.ceil(s["radius_km"] / s["speed_kmh"])
    fronts = []
    for _ in range(storms):
        center = rng.choice(stations)
        reached = [center[0], *(t[0] for t in stations if t is not center and km_between(*center[1:], *t[1:]) <= s["radius_km"])]
        spot = placed(length, lambda: reached)  # noqa: B023
        if spot:
            draw = {k: rng.randint(*v) if k == "onset_h" else rng.uniform(*v) for k, v in STORM_SIZE.items()}
            fronts.append((f"STORM_{len(fronts) + 1:03d}", center[0], first_hour + spot[1] * 3600, draw["strength"], draw["onset_h"], draw["temp_drop"], draw["rh_rise"], draw["pressure_rise"]))
    out = []
    for fault in FAULTS:
        count = 0
        for _ in range(per_fault):
            variable, n = rng.choice(VARIABLES), rng.randint(*DURATION[fault])
            spot = placed(n, lambda: [rng.choice(names)])
            if spot is None:
                continue
            count += 1
            lo, hi = CONFIG["range"][variable]
            size = {
                "DROPOUT": lambda: rng.choice([None, -9999.0, *([0.0] if variable == "pressure_hpa" else [])]),  # noqa: B023
                "OUT_OF_RANGE": lambda: rng.choice([lo - CONFIG["margin"][variable], hi + CONFIG["margin"][variable]]),  # noqa: B023
                "NOISE": lambda: rng.uniform(1.5, 4.0),
                "FROZEN": lambda: 0.0,
            }.get(fault, lambda: rng.choice([-1, 1]) * rng.uniform(*SIZE[fault][variable]))()  # noqa: B023
            out.append((f"{fault}_{count:03d}", spot[0][0], variable, fault, first_hour + spot[1] * 3600, n, size, fault == "SPIKE" and variable == "rh_pct"))
    return fronts, out


def build_test_set(readings: DataFrame, stations: DataFrame, per_fault: int = 40, storms: int = 10, seed: int = CONFIG["seed"]) -> DataFrame:
    """Labelled readings with planned storms and faults. The plan needs the network's stations and the record's first and last hour, no readings."""
    spark = readings.sparkSession
    span = readings.agg(F.unix_timestamp(F.min("ts")).alias("a"), F.unix_timestamp(F.max("ts")).alias("b")).first()
    places = [(r["station_id"], r["lat"], r["lon"]) for r in stations.select("station_id", "lat", "lon").orderBy("station_id").collect()]
    if span["a"] is None or not places:
        return add_labels(readings)
    fronts, faults = plan_test_set(places, span["a"], (span["b"] - span["a"]) // 3600 + 1, per_fault, storms, seed)
    at = lambda rows, kinds: spark.createDataFrame(rows, kinds).withColumn("start", F.timestamp_seconds("at")).drop("at")
    out = inject_storms(add_labels(readings), stations, at(fronts, STORMS.replace("start timestamp", "at long")))
    return inject_faults(out, at(faults, EVENTS.replace("start timestamp", "at long") + ", free_sign boolean"))


def next_event_id(labelled: DataFrame, prefix: str) -> str:
    """The name of the next event of a kind: one more than there are."""
    n = labelled.where(F.col("event_id").startswith(prefix)).agg(F.countDistinct("event_id")).first()[0]
    return f"{prefix}_{n + 1:03d}"
