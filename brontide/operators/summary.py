"""Alert runs, weather events, feeds, indicators and exports over RESULT rows.

RESULT: station_id, ts, variable, value, status, fault_type, confidence, severity, corrected_value, trust.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brontide.config import CONFIG, FLAGGED, VARIABLES
from brontide.functions.scalars import dewpoint_c, in_range, worst_severity, worst_status
from brontide.operators.history import by_sensor
from brontide.operators.ingest import long_form
from brontide.operators.spatial import neighbour_median
from brontide.sources.folders import written

HOUR = 3600
RUN = "kind string, station_id string, variable string, status string, fault_type string, severity string, confidence double, value double, corrected double, start timestamp, end timestamp, trust_before double, trust_after double"


def _seconds(c):
    return F.unix_timestamp(c)


def run_numbers(df: DataFrame, window, *keys: str) -> DataFrame:
    """run: counts up where a key changes or an hour is left out, along the window's order."""
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.lag(k).over(window))
    fresh = ~F.coalesce(same & (_seconds("ts") - _seconds(F.lag("ts").over(window)) == HOUR), F.lit(False))
    return df.withColumn("run", F.sum(fresh.cast("int")).over(window))


def _evidence(results: DataFrame) -> list[str]:
    return [c for c in ("reasons", "scores") if c in results.columns]


def fault_runs(results: DataFrame) -> DataFrame:
    """One row for each stretch of consecutive flagged hours of a sensor with one kind of fault; reasons and scores, where results have them, are those of its plainest hour."""
    flagged = results.where(F.col("status").isin(*FLAGGED)).withColumn("kind_of", F.coalesce("fault_type", F.lit("")))
    runs = run_numbers(flagged, by_sensor(), "kind_of")
    gap = F.abs(F.col("value") - F.col("corrected_value"))
    # the plainest hour: the widest gap, the earliest of equal ones; without any gap the last hour
    order = F.struct(F.coalesce(gap, F.lit(0.0)).alias("gap"), F.when(gap > 0, -_seconds("ts")).otherwise(_seconds("ts")).alias("at"))
    g = runs.groupBy("station_id", "variable", "run", "kind_of").agg(
        worst_status(F.col("status")).alias("status"),
        worst_severity(F.col("severity")).alias("severity"),
        F.max("confidence").alias("confidence"),
        F.max_by(F.struct("value", "corrected_value", *_evidence(results)), order).alias("peak"),
        F.min("ts").alias("start"),
        F.max("ts").alias("end"),
        F.max_by("trust", "ts").alias("trust_after"),
    )
    before = results.select("station_id", "variable", F.timestamp_seconds(_seconds("ts") + HOUR).alias("start"), F.col("trust").alias("trust_before"))
    return g.join(before, ["station_id", "variable", "start"], "left").select(
        F.lit("fault").alias("kind"), "station_id", "variable", "status", F.expr("nullif(kind_of, '')").alias("fault_type"), "severity", "confidence", F.col("peak.value").alias("value"), F.col("peak.corrected_value").alias("corrected"), "start", "end", F.coalesce("trust_before", F.lit(100.0)).alias("trust_before"), "trust_after", *[F.col(f"peak.{c}").alias(c) for c in _evidence(results)],
    )


def station_events(results: DataFrame) -> DataFrame:
    """Stretches of consecutive hours with a genuine event at a station; confidence is the station's highest in all of them.

    Where results have them: the reasons of the first hour, and the scores of the last one, when the front has reached the neighbours
    too; temperature speaks before the other variables, which come in order of name.
    """
    lead, have = F.struct((F.col("variable") != "temp_c").alias("k"), "variable"), _evidence(results)
    hours = results.where(F.col("status") == "GENUINE_EVENT").groupBy("station_id", "ts").agg(F.max("confidence").alias("confidence"), *[F.min_by(c, lead).alias(c) for c in have])
    w = Window.partitionBy("station_id").orderBy("ts")
    runs = run_numbers(hours, w).withColumn("top", F.max("confidence").over(Window.partitionBy("station_id")))
    told = [{"reasons": F.min_by, "scores": F.max_by}[c](c, "ts").alias(c) for c in have]
    return runs.groupBy("station_id", "run").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.max("top").alias("confidence"), *told).drop("run")


#: Seconds of a slice of the record.
SLICE_S = 32 * 86400


def joined_intervals(intervals: DataFrame, gap_s: int = HOUR, slice_s: int = SLICE_S) -> DataFrame:
    """start, event for each distinct start of ``intervals`` (start, end): intervals that overlap, or follow within the gap, have one event, numbered in order of time.

    In two levels: slices of the record each know how far their intervals reach and how many events begin in them, and what a slice
    needs of all before it is the furthest end and a count. Only these few numbers, one row for each slice, are summed up along the whole record.
    The distinct starts, a few thousand a year, are written once, so that the intervals are worked out once.
    """
    x = written(intervals.groupBy("start").agg(F.max("end").alias("end")).withColumn("slice", F.floor(_seconds("start") / slice_s)))
    whole = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    reach = x.groupBy("slice").agg(F.max("end").alias("end")).select("slice", F.max("end").over(whole).alias("before"))
    own = Window.partitionBy("slice").orderBy("start")
    reached = F.greatest(F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.col("before"))
    x = x.join(reach, "slice").withColumn("fresh", F.when(_seconds("start") <= _seconds(reached) + gap_s, 0).otherwise(1))
    begun = x.groupBy("slice").agg(F.sum("fresh").alias("n")).select("slice", F.coalesce(F.sum("n").over(whole), F.lit(0)).alias("first"))
    return x.withColumn("own", F.sum("fresh").over(own)).join(begun, "slice").select("start", (F.col("first") + F.col("own")).alias("event"))


def weather_events(results: DataFrame) -> DataFrame:
    """Stretches that overlap or follow within an hour are one event, whatever the stations."""
    parts = station_events(results)
    events = joined_intervals(parts.select("start", "end"))
    lead = F.struct("start", "station_id")
    return parts.join(events, "start").groupBy("event").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("station_id", lead).alias("station_id"), F.min_by("confidence", lead).alias("confidence"), *[F.min_by(c, lead).alias(c) for c in _evidence(results)], F.count("*").alias("parts"), F.array_join(F.transform(F.array_sort(F.collect_list(lead)), lambda s: s["station_id"]), ", ").alias("stations"),
    ).drop("event")


def alerts(results: DataFrame) -> DataFrame:
    """Fault runs and weather events under one set of columns."""
    w = weather_events(results).select(F.lit("weather").alias("kind"), "station_id", F.lit("GENUINE_EVENT").alias("status"), "confidence", "start", "end", "stations", *_evidence(results))
    return fault_runs(results).unionByName(w, allowMissingColumns=True)


def alert_feed(results: DataFrame, now, limit: int = 30) -> DataFrame:
    """alerts with active: those going on now, and the newest others up to the limit."""
    items = alerts(results).withColumn("active", F.col("end") == now)
    going = items.where("active")
    n = going.count()
    order = [F.desc("start"), "kind", "station_id", F.col("variable").asc_nulls_first(), F.col("fault_type").asc_nulls_first()]
    earlier = items.where("not active").orderBy(*order).limit(max(limit - n, 0))
    return going.unionByName(earlier)


def station_status(results: DataFrame, now) -> DataFrame:
    return results.where(F.col("ts") == now).groupBy("station_id").agg(worst_status(F.col("status")).alias("status"), F.min("trust").alias("trust"))


def fault_counts(results: DataFrame, now) -> DataFrame:
    """One row: runs of flagged hours that hold a fault, and those of them that reach to now."""
    flagged = results.where(F.col("status").isin(*FLAGGED)).select("station_id", "variable", "ts", "status", F.coalesce("fault_type", F.lit("")).alias("kind_of"))
    runs = run_numbers(flagged, by_sensor(), "kind_of").groupBy("station_id", "variable", "run").agg(F.max(F.col("status") == "SENSOR_FAULT").alias("fault"), F.max("ts").alias("end"))
    return runs.where("fault").agg(F.count("*").alias("faults"), F.coalesce(F.sum((F.col("end") == now).cast("long")), F.lit(0)).alias("open"))


def event_count(results: DataFrame) -> DataFrame:
    """One row: how many weather events there are. They cover the hours that some station has a genuine event in."""
    hours = results.where(F.col("status") == "GENUINE_EVENT").select(F.col("ts").alias("start"), F.col("ts").alias("end"))
    return joined_intervals(hours).agg(F.count_distinct("event").alias("events"))


def kpis(results: DataFrame, now, step_ms: tuple = ()) -> DataFrame:
    """One row: the least trusted sensor, open faults, faults and events of the last 24 hours, mean step time of the last 24 steps."""
    day = results.where(F.col("ts") > F.timestamp_seconds(_seconds(now) - 24 * HOUR))
    low = day.where(F.col("ts") == now).agg(F.min(F.struct("trust", "station_id", "variable")).alias("l"))
    # a day has few distinct hours, so one window goes over them
    hours = day.where(F.col("status") == "GENUINE_EVENT").select("ts").distinct()
    fresh = _seconds("ts") > F.coalesce(_seconds(F.lag("ts").over(Window.orderBy("ts"))) + HOUR, F.lit(0))
    events = hours.select(fresh.alias("fresh")).agg(F.count_if("fresh").alias("events_24h"))
    last = step_ms[-24:]
    one = low.crossJoin(fault_counts(day, now)).crossJoin(events)
    return one.select(F.col("l.trust").alias("lowest_trust"), F.col("l.station_id").alias("lowest_station"), F.col("l.variable").alias("lowest_variable"), F.col("open").alias("open_faults"), F.col("faults").alias("faults_24h"), "events_24h", F.lit(sum(last) / len(last) if last else None).cast("double").alias("step_ms"))


def trust_now(results: DataFrame, now) -> DataFrame:
    return results.where(F.col("ts") == now).select("station_id", "variable", "trust")


def retained(results: DataFrame, now, hours: int = 7 * 24) -> DataFrame:
    """What a replay keeps: the results of the last hours."""
    return results.where((F.col("ts") > F.timestamp_seconds(_seconds(now) - hours * HOUR)) & (F.col("ts") <= now))


def evidence_flags(scores: DataFrame) -> DataFrame:
    """Rows with a struct ``scores`` and the three checks behind a decision: true, false, or null where there is none yet."""
    return scores.withColumns({
        "physics_ok": F.col("scores.physics") < 0.5,
        "neighbours_ok": F.abs("scores.spatial_z") <= CONFIG["z"],
        "pattern_ok": F.col("scores.iforest") < CONFIG["high"],
    })


def maintenance(results: DataFrame, now, threshold: float = 50) -> DataFrame:
    """Sensors under the threshold now with the last fault seen."""
    last = results.where("status = 'SENSOR_FAULT' and fault_type is not null").groupBy("station_id", "variable").agg(F.max_by("fault_type", "ts").alias("last_fault"))
    current = results.where((F.col("ts") == now) & (F.col("trust") < threshold)).select("station_id", "variable", "trust")
    return current.join(last, ["station_id", "variable"], "left").orderBy("trust", "station_id", "variable")


def alert_log(results: DataFrame, stations: DataFrame, tz: str = "UTC") -> DataFrame:
    """Every alert as text and numbers for export, the newest first."""
    local = lambda c: F.date_format(F.from_utc_timestamp(c, tz), "yyyy-MM-dd HH:mm")
    a = alerts(results).join(stations.select("station_id", "name"), "station_id", "left")
    weather = F.col("kind") == "weather"
    return a.select(
        local("start").alias("start"), local("end").alias("end"), ((_seconds("end") - _seconds("start")) / HOUR + 1).cast("long").alias("hours"),
        F.when(weather, F.col("stations")).otherwise(F.concat_ws(" ", "station_id", F.coalesce("name", F.lit("")))).alias("station"),
        F.when(weather, "").otherwise(F.col("variable")).alias("sensor"), "status", F.coalesce("fault_type", F.lit("")).alias("fault_type"), F.coalesce("severity", F.lit("")).alias("severity"),
        F.round("confidence", 2).alias("confidence"), F.col("value").alias("reported"), "corrected",
    ).orderBy(F.desc("start"), "end", "station", "sensor", "fault_type")


def health_matrix(results: DataFrame, stations: DataFrame, now, hours: int = 72) -> DataFrame:
    """Worst status by sensor and hour of the last hours, in long form, with every station and variable; null: no data."""
    recent = results.where((F.col("ts") > F.timestamp_seconds(_seconds(now) - hours * HOUR)) & (F.col("ts") <= now))
    cells = recent.groupBy("station_id", "variable", "ts").agg(worst_status(F.col("status")).alias("status"))
    sensors = stations.select("station_id", F.explode(F.array(*map(F.lit, VARIABLES))).alias("variable"))
    return sensors.join(cells, ["station_id", "variable"], "left")


def link_states(results: DataFrame, links: DataFrame, now) -> DataFrame:
    """Links (a, b) with a state: fault if an end is faulty, weather if both have an event, else plain."""
    s = station_status(results, now).select("station_id", "status")
    x = links.join(s.select(F.col("station_id").alias("a"), F.col("status").alias("sa")), "a", "left").join(s.select(F.col("station_id").alias("b"), F.col("status").alias("sb")), "b", "left")
    both = lambda v: (F.coalesce(F.col("sa"), F.lit("")) == v, F.coalesce(F.col("sb"), F.lit("")) == v)
    f, w = both("SENSOR_FAULT"), both("GENUINE_EVENT")
    return x.select("a", "b", F.when(f[0] | f[1], "fault").when(w[0] & w[1], "weather").otherwise("plain").alias("state"))


def station_panel(readings: DataFrame, results: DataFrame, edges: DataFrame, station: str, now, hours: int = 48) -> DataFrame:
    """A station's last hours, a row for each hour and variable of its readings: what it reported in range, the corrected value and the
    place of a mark where it was flagged, the neighbours' median, whether weather was at the station, and on temperature rows the dewpoint."""
    within = (F.col("ts") > F.timestamp_seconds(_seconds(now) - hours * HOUR)) & (F.col("ts") <= now)
    home = within & (F.col("station_id") == station)
    keys = ["station_id", "ts", "variable"]
    ok = {v: F.when(in_range(F.col(v), F.lit(v)), F.col(v)) for v in VARIABLES}
    own = readings.where(home).withColumn("_dew", dewpoint_c(ok["temp_c"], ok["rh_pct"]))
    long = long_form(own, ("_dew",)).withColumns({"reported": F.when(in_range(F.col("value")), F.col("value")), "dewpoint": F.when(F.col("variable") == "temp_c", F.col("_dew"))}).drop("_dew")
    flagged = F.col("status").isin(*FLAGGED)
    r = results.where(home).select(*keys, "status", "fault_type", F.when(flagged, F.col("corrected_value")).alias("corrected"))
    weather = results.where(home & (F.col("status") == "GENUINE_EVENT")).select("station_id", "ts").distinct().withColumn("weather", F.lit(True))
    near = neighbour_median(long_form(readings.where(within)), edges.where(F.col("station_id") == station))
    out = long.join(r, keys, "left").join(weather, ["station_id", "ts"], "left").join(near, keys, "left")
    return out.withColumns({"weather": F.coalesce("weather", F.lit(False)), "mark": F.when(flagged, F.coalesce("reported", "corrected"))})
