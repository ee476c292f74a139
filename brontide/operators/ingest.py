"""Cleaning: hourly grid, gaps, interpolation, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brontide.config import CONFIG, VARIABLES


def long_form(readings: DataFrame, keep: tuple = ()) -> DataFrame:
    """One row for each station, hour and variable."""
    parts = F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).alias("value")) for v in VARIABLES])
    return readings.select("station_id", "ts", *keep, F.inline(parts))


def select_split(readings: DataFrame, first: str, last: str) -> DataFrame:
    """Both days inclusive."""
    return readings.where((F.col("ts") >= F.to_timestamp(F.lit(first))) & (F.col("ts") < F.to_timestamp(F.lit(last)) + F.expr("interval 1 day")))


def hourly_grid(readings: DataFrame) -> DataFrame:
    """Every hour from a station's first to its last reading; hours off the grid vanish."""
    span = readings.groupBy("station_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    grid = span.select("station_id", F.explode(F.sequence("a", "b", F.expr("interval 1 hour"))).alias("ts"))
    return grid.join(readings, ["station_id", "ts"], "left")


def gap_lengths(grid: DataFrame, variable: str) -> DataFrame:
    """The length of the missing stretch that each missing hour belongs to, 0 for present ones."""
    w = Window.partitionBy("station_id").orderBy("ts")
    missing = F.col(variable).isNull()
    change = F.coalesce((missing != F.lag(missing).over(w)).cast("int"), F.lit(1))
    runs = grid.withColumn("_run", F.sum(change).over(w))
    return runs.withColumn("gap", F.when(missing, F.count("*").over(Window.partitionBy("station_id", "_run"))).otherwise(0)).drop("_run")


def interpolate(grid: DataFrame, most: int = CONFIG["max_gap"]) -> DataFrame:
    """Linear by position inside the data; stretches longer than ``most`` hours stay null as a whole."""
    out = grid
    w = Window.partitionBy("station_id").orderBy("ts")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    n = F.row_number().over(w)
    for v in VARIABLES:
        out = gap_lengths(out, v).withColumn("_n", n)
        spot = F.when(F.col(v).isNotNull(), F.struct(F.col("_n").alias("n"), F.col(v).alias("v")))
        out = out.withColumn("_a", F.last(spot, True).over(back)).withColumn("_b", F.first(spot, True).over(ahead))
        line = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * (F.col("_n") - F.col("_a.n")) / (F.col("_b.n") - F.col("_a.n"))
        out = out.withColumn(v, F.when(F.col(v).isNotNull(), F.col(v)).when(F.col("gap") <= most, line)).drop("gap", "_n", "_a", "_b")
    return out
