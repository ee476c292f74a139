"""The eleven model features of every sensor and hour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brontide.config import FEATURES
from brontide.operators.climatology import with_climatology
from brontide.operators.history import by_sensor, same_value_run, sensor_history


def feature_frame(readings: DataFrame, clim: DataFrame, keep: tuple = ()) -> DataFrame:
    """station_id, ts, variable and FEATURES; what is null is 0."""
    x = same_value_run(sensor_history(readings, keep))
    v = F.col("value")
    x = x.withColumns({
        "diff_1": v - F.col("lag1"),
        "diff_3": v - F.col("lag3"),
        "std_6": F.stddev_samp(v).over(by_sensor().rowsBetween(-5, 0)),
        "std_24": F.stddev_samp(v).over(by_sensor().rowsBetween(-23, 0)),
        "run_length": F.col("run").cast("double"),
        "dewpoint_value": F.col("dewpoint"),
        "dewpoint_delta": F.col("dewpoint") - F.col("prev_dewpoint"),
    })
    angle = F.lit(2 * 3.141592653589793) * (F.hour("ts") + F.minute("ts") / 60) / 24
    x = with_climatology(x, clim).withColumns({"hour_sin": F.sin(angle), "hour_cos": F.cos(angle)})
    return x.select("station_id", "ts", "variable", *keep, *[F.coalesce(F.col(f), F.lit(0.0)).alias(f) for f in FEATURES])


def signal_features(signals: DataFrame) -> DataFrame:
    """signals (value, lags, std_6, std_24, run_length, dewpoints, dev_sigma) with features: FEATURES in order as an array, null as 0, to six decimals as the trees read them."""
    angle = F.lit(2 * 3.141592653589793) * (F.hour("ts") + F.minute("ts") / 60) / 24
    own = {"diff_1": F.col("value") - F.col("lag1"), "diff_3": F.col("value") - F.col("lag3"), "dewpoint_value": F.col("dewpoint"), "dewpoint_delta": F.col("dewpoint") - F.col("prev_dewpoint"), "hour_sin": F.sin(angle), "hour_cos": F.cos(angle)}
    return signals.withColumn("features", F.array(*[F.round(F.coalesce(own[f] if f in own else F.col(f), F.lit(0.0)), 6) for f in FEATURES]))
