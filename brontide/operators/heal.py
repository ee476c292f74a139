"""Corrected values, and trust in a sensor."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brontide.config import CONFIG
from brontide.functions.scalars import in_range
from brontide.operators.history import by_sensor
from brontide.sources.folders import written


def extrapolate(long: DataFrame) -> DataFrame:
    """long with temporal: a line through the last two in-range values before the row, or the last one."""
    ok = F.when(in_range(F.col("value")), F.col("value"))
    before = by_sensor().rowsBetween(Window.unboundedPreceding, -1)
    x = long.withColumn("_prev", F.last(ok, True).over(before))
    pair = F.when(ok.isNotNull(), F.struct(F.col("value").alias("v"), F.col("_prev").alias("p")))
    x = x.withColumn("_last", F.last(pair, True).over(before))
    return x.withColumn("temporal", F.coalesce(2 * F.col("_last.v") - F.col("_last.p"), F.col("_last.v"))).drop("_prev", "_last")


def impute(df: DataFrame) -> DataFrame:
    """df (mean, near_anomaly, temporal) with corrected_value."""
    ws, wt = CONFIG["impute"]
    spatial, temporal = F.col("mean") + F.col("near_anomaly"), F.col("temporal")
    return df.withColumn("corrected_value", F.coalesce((ws * spatial + wt * temporal) / (ws + wt), spatial, temporal, F.col("mean")))


def trust_change(status="status", severity="severity"):
    penalty = F.create_map(*[F.lit(x) for kv in CONFIG["trust_penalty"].items() for x in kv])
    return F.when(F.col(status) == "SENSOR_FAULT", -penalty[F.coalesce(severity, F.lit("LOW"))]).when(F.col(status) == "NORMAL", CONFIG["trust_recovery"]).otherwise(0.0)


#: Seconds of a block of a sensor's history.
BLOCK_S = 32 * 86400


def _bounded(x, low=0.0, high=100.0):
    return F.least(F.greatest(x, F.lit(low) if isinstance(low, float) else low), F.lit(high) if isinstance(high, float) else high)


def composed(changes):
    """An array of changes as one map of trust: shift, low and high, so that trust before becomes least(greatest(trust + shift, low), high).

    Adding a change within bounds is such a map, and so are such maps one after the other.
    """
    start = F.struct(F.lit(0.0).alias("shift"), F.lit(0.0).alias("low"), F.lit(100.0).alias("high"))
    return F.aggregate(changes, start, lambda m, d: F.struct((m["shift"] + d).alias("shift"), _bounded(m["low"] + d).alias("low"), _bounded(m["high"] + d).alias("high")))


def trust_scores(results: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """results (station_id, variable, ts, status, severity, other columns that can be sorted) with trust: changes added in order of time, kept within
    0 and 100, from the usual start or from that of each sensor in start (station_id, variable, trust).

    A scan by blocks of a month: the changes of each block are composed to one map, the few maps of a sensor lead
    from block to block, and each block is then gone through from its own start. No task holds more than a block of
    a sensor's rows. The results are written once, as both passes read them.
    """
    keys = ["station_id", "variable", "_block"]
    x = written(results.withColumn("_change", trust_change()).withColumn("_block", F.floor(F.unix_timestamp("ts") / BLOCK_S)))
    by_time = lambda *c: F.sort_array(F.collect_list(F.struct("ts", *c)))
    maps = x.groupBy(*keys).agg(by_time("_change").alias("c")).select(*keys, composed(F.transform("c", lambda r: r["_change"])).alias("m"))
    sensors = maps.groupBy("station_id", "variable").agg(F.sort_array(F.collect_list(F.struct("_block", "m"))).alias("maps"))
    begin = F.lit(CONFIG["trust_start"])
    if start is not None:
        sensors = sensors.join(start.select("station_id", "variable", F.col("trust").alias("_given")), ["station_id", "variable"], "left")
        begin = F.coalesce("_given", begin)
    # where each block starts: what the maps before it make of the sensor's start
    led = F.aggregate("maps", F.struct(begin.alias("now"), F.array().cast("array<double>").alias("out")), lambda a, b: F.struct(_bounded(a["now"] + b["m"]["shift"], b["m"]["low"], b["m"]["high"]).alias("now"), F.array_append(a["out"], a["now"]).alias("out")))
    begins = sensors.select("station_id", "variable", F.explode(F.arrays_zip(F.transform("maps", lambda b: b["_block"]).alias("block"), led["out"].alias("begin"))).alias("b")).select("station_id", "variable", F.col("b.block").alias("_block"), F.col("b.begin").alias("_begin"))
    rest = [c for c in results.columns if c != "ts"]
    blocks = x.groupBy(*keys).agg(by_time("_change", F.struct(*rest).alias("row")).alias("rows")).join(begins, keys)
    gone = F.aggregate("rows", F.struct(F.col("_begin").alias("now"), F.array().cast("array<double>").alias("out")), lambda a, r: F.struct(_bounded(a["now"] + r["_change"]).alias("now"), F.array_append(a["out"], _bounded(a["now"] + r["_change"])).alias("out")))
    out = blocks.select(F.explode(F.arrays_zip(F.col("rows").alias("r"), gone["out"].alias("trust"))).alias("z"))
    return out.select(*[F.col("z.r.ts") if c == "ts" else F.col(f"z.r.row.{c}") for c in results.columns], "z.trust")
