"""Agreement with neighbours, and what they say a value should have been."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brontide.config import CONFIG, VARIABLES
from brontide.functions.scalars import array_median, by_variable, in_range
from brontide.operators.climatology import with_climatology
from brontide.operators.ingest import long_form


def around(anomalies: DataFrame, edges: DataFrame) -> DataFrame:
    """For each station, hour and variable: the neighbours' anomalies then, and those of in-range values.

    Summed up before the time offsets are applied, so each neighbour's reading is shuffled once per edge, not five times.
    """
    n = anomalies.select(F.col("station_id").alias("neighbour_id"), "ts", "variable", "anomaly", in_range(F.col("value")).alias("ok")).where("anomaly is not null")
    return (
        edges.select("station_id", "neighbour_id")
        .join(n, "neighbour_id")
        .groupBy("station_id", "ts", "variable")
        .agg(F.collect_list("anomaly").alias("all"), F.collect_list(F.when(F.col("ok"), F.col("anomaly"))).alias("good"))
    )


def _at_offsets(home: DataFrame, near: DataFrame) -> DataFrame:
    h = CONFIG["window_h"]
    shifted = near.withColumn("offset", F.explode(F.array(*[F.lit(k) for k in range(-h, h + 1)]))).withColumn("ts", F.timestamp_seconds(F.unix_timestamp("ts") - F.col("offset") * 3600))
    return home.join(shifted, ["station_id", "ts", "variable"])


def spatial_check(anomalies: DataFrame, near: DataFrame) -> DataFrame:
    """station_id, ts, variable, z, n, consistent for the offset with the least |z|, the earliest of equal ones.

    No row where no hour has enough neighbours. Without a home anomaly z is null and consistent false.
    """
    med = array_median(F.col("all"))
    stats = near.where(F.size("all") >= CONFIG["min_neighbours"]).withColumn("med", med).select("station_id", "ts", "variable", "med", F.size("all").alias("n"), array_median(F.transform("all", lambda a: F.abs(a - F.col("med")))).alias("mad"))
    x = _at_offsets(anomalies.select("station_id", "ts", "variable", "anomaly"), stats)
    z = (F.col("anomaly") - F.col("med")) / (1.4826 * F.col("mad") + by_variable(CONFIG["mad_floor"]))
    best = x.withColumn("z", z).groupBy("station_id", "ts", "variable").agg(F.min_by(F.struct("z", "n", "offset"), F.struct(F.abs("z").alias("a"), "offset")).alias("b"))
    return best.select("station_id", "ts", "variable", "b.z", "b.n", "b.offset", F.coalesce(F.abs("b.z") <= CONFIG["z"], F.lit(False)).alias("consistent"))


def neighbour_anomaly(home: DataFrame, near: DataFrame) -> DataFrame:
    """station_id, ts, variable and the median anomaly of all in-range neighbour readings within the hours around."""
    x = _at_offsets(home.select("station_id", "ts", "variable"), near.select("station_id", "ts", "variable", "good"))
    return x.groupBy("station_id", "ts", "variable").agg(array_median(F.flatten(F.collect_list("good"))).alias("near_anomaly"))


def neighbour_signals(home: DataFrame, near: DataFrame) -> DataFrame:
    """What spatial_check and neighbour_anomaly say, from one pass over the hours around: z, n, offset, consistent and near_anomaly."""
    return _verdicts(_at_offsets(home.select("station_id", "ts", "variable", "anomaly"), near.select("station_id", "ts", "variable", "all", "good")))


def _verdicts(x: DataFrame) -> DataFrame:
    """x: a home reading's anomaly beside its neighbours' at each offset."""
    n = F.when(F.size("all") >= CONFIG["min_neighbours"], F.size("all"))
    x = x.withColumn("med", array_median(F.col("all"))).withColumns({"n": n, "mad": array_median(F.transform("all", lambda a: F.abs(a - F.col("med"))))})
    z = (F.col("anomaly") - F.col("med")) / (1.4826 * F.col("mad") + by_variable(CONFIG["mad_floor"]))
    best = F.min_by(F.struct("z", "n", "offset"), F.when(F.col("n").isNotNull(), F.struct(F.abs("z").alias("a"), "offset")))
    g = x.withColumn("z", z).groupBy("station_id", "ts", "variable").agg(best.alias("b"), array_median(F.flatten(F.collect_list("good"))).alias("near_anomaly"))
    consistent = F.when(F.col("b").isNotNull(), F.coalesce(F.abs("b.z") <= CONFIG["z"], F.lit(False)))
    return g.select("station_id", "ts", "variable", "b.z", F.coalesce("b.n", F.lit(0)).alias("n"), "b.offset", consistent.alias("consistent"), "near_anomaly")


def judge_around(df: DataFrame) -> DataFrame:
    """df (anomaly, around: the neighbours' anomalies by offset) with what neighbour_signals says."""
    floor = by_variable(CONFIG["mad_floor"])
    enough = F.filter("around", lambda o: F.size(o["all"]) >= CONFIG["min_neighbours"])
    middle = F.transform(enough, lambda o: F.struct(o["offset"].alias("offset"), F.size(o["all"]).alias("n"), o["all"].alias("all"), array_median(o["all"]).alias("med")))
    told = F.transform(middle, lambda o: F.struct(o["offset"].alias("offset"), o["n"].alias("n"), ((F.col("anomaly") - o["med"]) / (1.4826 * array_median(F.transform(o["all"], lambda a: F.abs(a - o["med"]))) + floor)).alias("z")))
    best = F.array_min(F.transform(told, lambda o: F.struct(F.abs(o["z"]).alias("away"), o["offset"].alias("offset"), o["n"].alias("n"), o["z"].alias("z"))))
    x = df.withColumn("best", best).withColumn("near_anomaly", array_median(F.flatten(F.transform("around", lambda o: o["good"]))))
    consistent = F.when(F.col("best").isNotNull(), F.coalesce(F.abs("best.z") <= CONFIG["z"], F.lit(False)))
    return x.withColumns({"z": F.col("best.z"), "n": F.coalesce("best.n", F.lit(0)), "offset": F.col("best.offset"), "consistent": consistent}).drop("best", "around")


def asof_signals(readings: DataFrame, clim: DataFrame, edges: DataFrame, tolerance_s: int = 1800) -> DataFrame:
    """neighbour_signals of readings at any times: at each offset a neighbour speaks by its reading nearest to that time, the earlier of
    two equally near ones, if it is within the tolerance; its usual value is that of the hour asked for.

    Readings are posted in slots of the tolerance's length and the two beside, so the join is one of equal slots.
    """
    h = CONFIG["window_h"]
    slot = lambda c: F.floor(F.unix_micros(c) / (tolerance_s * 1_000_000))
    home = with_climatology(long_form(readings), clim).select("station_id", "ts", "variable", "anomaly")
    asked = readings.select("station_id", "ts").distinct().withColumn("offset", F.explode(F.array(*[F.lit(k) for k in range(-h, h + 1)])))
    asked = asked.withColumn("target", F.timestamp_micros(F.unix_micros("ts") + F.col("offset") * 3_600_000_000)).join(edges.select("station_id", "neighbour_id"), "station_id").withColumn("slot", slot("target"))
    posted = readings.select(F.col("station_id").alias("neighbour_id"), F.col("ts").alias("at"), F.struct(*VARIABLES).alias("r"), F.explode(F.sequence(slot("ts") - 1, slot("ts") + 1)).alias("slot"))
    away = F.abs(F.unix_micros("at") - F.unix_micros("target"))
    met = asked.join(posted, ["neighbour_id", "slot"]).where(away <= tolerance_s * 1_000_000)
    nearest = met.groupBy("station_id", "ts", "offset", "target", "neighbour_id").agg(F.min_by("r", F.struct(away.alias("a"), "at")).alias("r"))
    values = long_form(nearest.select(F.col("neighbour_id").alias("station_id"), F.col("target").alias("ts"), F.col("station_id").alias("home"), F.col("ts").alias("home_ts"), "offset", "r.*"), ("home", "home_ts", "offset"))
    told = with_climatology(values, clim).where("anomaly is not null").withColumn("ok", in_range(F.col("value")))
    near = told.groupBy(F.col("home").alias("station_id"), F.col("home_ts").alias("ts"), "variable", "offset").agg(F.collect_list("anomaly").alias("all"), F.collect_list(F.when(F.col("ok"), F.col("anomaly"))).alias("good"))
    return _verdicts(home.join(near, ["station_id", "ts", "variable"]))


def interval_anomaly(anomalies: DataFrame, edges: DataFrame) -> DataFrame:
    """station_id, ts, variable and the median anomaly (near_anomaly) of all in-range neighbour readings within the hours around, at any times.

    Slots are as long as the hours on one side, so a reading's slot and the two beside it hold all that is near: an equi-join that posts each home time three times, and
    each neighbour's reading once.
    """
    reach = CONFIG["window_h"] * 3_600_000_000
    slot = F.floor(F.unix_micros("ts") / reach)
    asked = anomalies.select("station_id", "ts").distinct().withColumn("slot", F.explode(F.sequence(slot - 1, slot + 1))).join(edges.select("station_id", "neighbour_id"), "station_id")
    told = anomalies.where(F.col("anomaly").isNotNull() & in_range(F.col("value"))).select(F.col("station_id").alias("neighbour_id"), F.col("ts").alias("at"), "variable", "anomaly", slot.alias("slot"))
    met = asked.join(told, ["neighbour_id", "slot"]).where(F.abs(F.unix_micros("at") - F.unix_micros("ts")) <= reach)
    return met.groupBy("station_id", "ts", "variable").agg(array_median(F.collect_list("anomaly")).alias("near_anomaly"))


def offgrid_signals(readings: DataFrame, clim: DataFrame, edges: DataFrame, tolerance_s: int = 1800) -> DataFrame:
    """neighbour_signals of readings at any times: agreement by the nearest readings at each offset, and near_anomaly of all readings around."""
    z = asof_signals(readings, clim, edges, tolerance_s).drop("near_anomaly")
    near = interval_anomaly(with_climatology(long_form(readings), clim), edges)
    return z.join(near, ["station_id", "ts", "variable"], "full")


def neighbour_median(readings_long: DataFrame, edges: DataFrame) -> DataFrame:
    """Median of the neighbours' in-range values by station, hour and variable."""
    n = readings_long.where(in_range(F.col("value"))).withColumnRenamed("station_id", "neighbour_id")
    return edges.select("station_id", "neighbour_id").join(n, "neighbour_id").groupBy("station_id", "ts", "variable").agg(F.percentile("value", F.lit(0.5)).alias("median"))
