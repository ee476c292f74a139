"""Per station, month and hour: mean and floored standard deviation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brontide.config import CONFIG
from brontide.functions.scalars import by_variable


def fit_climatology(long: DataFrame) -> DataFrame:
    floor = by_variable(CONFIG["std_floor"])
    out = long.groupBy("station_id", F.month("ts").alias("month"), F.hour("ts").alias("hour"), "variable").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    return out.withColumn("std", F.greatest(F.coalesce("std", floor), floor))


def with_climatology(long: DataFrame, clim: DataFrame) -> DataFrame:
    """mean, std, anomaly and dev_sigma beside each value; null where the climatology has no entry."""
    keyed = long.withColumns({"month": F.month("ts"), "hour": F.hour("ts")})
    out = keyed.join(clim, ["station_id", "month", "hour", "variable"], "left").drop("month", "hour")
    return out.withColumn("anomaly", F.col("value") - F.col("mean")).withColumn("dev_sigma", F.try_divide(F.col("anomaly"), F.col("std")))
