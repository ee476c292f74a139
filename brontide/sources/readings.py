"""Sources and sinks: readings, stations, landing by coverage, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brontide.config import CONFIG, VARIABLES
from brontide.functions.scalars import no_nan

READINGS = "station_id string, ts timestamp, temp_c double, pressure_hpa double, rh_pct double"
STATIONS = "station_id string, name string, lat double, lon double, elevation_m int"


def check_zone(spark: SparkSession) -> None:
    """Hours and months of readings are UTC's, so the session must have a zone that shows them so, in winter and summer."""
    shown = spark.range(1).select(*[F.date_format(F.timestamp_seconds(F.lit(t)), "yyyy-MM-dd HH:mm") for t in (1704067200, 1719792000)]).first()
    if tuple(shown) != ("2024-01-01 00:00", "2024-07-01 00:00"):
        raise ValueError(f"spark.sql.session.timeZone must be UTC, not {spark.conf.get('spark.sql.session.timeZone')}")


def scan_readings(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files below a folder, all of them, with a fixed schema; NaN becomes null."""
    check_zone(spark)
    df = spark.read.schema(READINGS).option("recursiveFileLookup", "true").parquet(path)
    return df.select("station_id", "ts", *[no_nan(F.col(v)).alias(v) for v in VARIABLES])


def scan_stations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STATIONS).option("multiLine", "true").json(path)


def hourly_payload(payloads: DataFrame) -> DataFrame:
    """station_id, body (JSON of parallel arrays as the archive service returns them) -> READINGS."""
    kind = "struct<hourly:struct<time:array<string>,temperature_2m:array<double>,pressure_msl:array<double>,relative_humidity_2m:array<double>>>"
    rows = payloads.select("station_id", F.from_json("body", kind).alias("b")).select("station_id", F.explode(F.arrays_zip("b.hourly.time", "b.hourly.temperature_2m", "b.hourly.pressure_msl", "b.hourly.relative_humidity_2m")).alias("r"))
    # the service's times are UTC, whatever the session's zone
    return rows.select("station_id", F.to_timestamp(F.concat(F.substring("r.time", 1, 16), F.lit("Z")), "yyyy-MM-dd'T'HH:mmX").alias("ts"), F.col("r.temperature_2m").alias("temp_c"), F.col("r.pressure_msl").alias("pressure_hpa"), F.col("r.relative_humidity_2m").alias("rh_pct"))


def coverage(readings: DataFrame) -> DataFrame:
    """Share of non-null values per station and column, and whether all reach the limit."""
    out = readings.groupBy("station_id").agg(*[F.avg(F.col(v).isNotNull().cast("double")).alias(v) for v in VARIABLES])
    return out.withColumn("kept", F.least(*VARIABLES) >= CONFIG["coverage"])


def land(readings: DataFrame, path: str) -> None:
    """Stations with enough coverage, one folder each."""
    kept = coverage(readings).where("kept").select("station_id")
    readings.join(kept, "station_id", "left_semi").write.mode("overwrite").partitionBy("station_id").parquet(path)


def sample_of(readings: DataFrame, stations: int = 2, days: int = 31) -> DataFrame:
    """The first stations by name, and the first days of their record together."""
    first = readings.select("station_id").distinct().orderBy("station_id").limit(stations)
    own = readings.join(F.broadcast(first), "station_id", "left_semi")
    begin = own.agg(F.min("ts").alias("_begin"))
    return own.crossJoin(F.broadcast(begin)).where(F.unix_timestamp("ts") < F.unix_timestamp("_begin") + days * 86400).drop("_begin")


def scan_metrics(spark: SparkSession, path: str) -> DataFrame:
    """A metrics file as one row: per_fault by kind, the false alarm rates, accuracy of kinds, imputation errors and mean latency."""
    score = "struct<precision:double,recall:double,f1:double,events:long,tp:long,fp:long,fn:long>"
    kind = f"per_fault map<string,{score}>, false_alarm_rate_normal double, false_alarm_rate_storm double, fault_type_accuracy double, impute_mae map<string,double>, latency_ms_mean double"
    return spark.read.schema(kind).option("multiLine", "true").json(path)


def save_test_set(labelled: DataFrame, path: str) -> None:
    """Labelled readings by year and month of their time, one file for each."""
    dated = labelled.withColumns({"year": F.year("ts"), "month": F.month("ts")})
    dated.repartition("year", "month").write.mode("overwrite").partitionBy("year", "month").parquet(path)


def scan_test_set(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("year", "month")


def save_scores(scores: DataFrame, path: str) -> None:
    """Batch scores (station_id, ts, variable, raw, ml_score) by variable."""
    scores.select("station_id", "ts", "variable", "raw", "ml_score").repartition("variable").sortWithinPartitions("station_id", "ts").write.mode("overwrite").partitionBy("variable").parquet(path)


def export_csv(log: DataFrame, path: str) -> None:
    log.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def events_as_readings(events: DataFrame) -> DataFrame:
    """READINGS and event_id from the event table: the first event of a station and hour, with planted stretches.

    Values are dyadic rationals, so sums do not depend on the order of rows.
    """
    ts, h = F.date_trunc("hour", F.col("ts").cast("timestamp")), F.hour(F.col("ts").cast("timestamp"))
    rows = events.select(F.concat(F.lit("ST-"), (F.col("user_id") % 8 + 1).cast("string")).alias("station_id"), ts.alias("hour"), F.struct(F.col("ts").alias("at"), "event_id", h.alias("h"), F.round(F.col("value") * 100).cast("bigint").alias("cents")).alias("e"))
    e = rows.groupBy("station_id", "hour").agg(F.min("e").alias("e")).select("station_id", F.col("hour").alias("ts"), "e.event_id", "e.h", "e.cents")
    out = F.abs(F.col("h") - 14)
    temp = F.when(F.col("event_id") % 97 == 0, -9999.0).when(F.col("event_id") % 89 != 0, 34 - 0.75 * out + (F.col("cents") % 128) / 64)
    pressure = F.when(F.col("event_id") % 83 == 0, 0.0).otherwise(1000 + (F.col("cents") % 64) / 32)
    rh = F.when(F.col("event_id") % 79 == 0, 107.0).otherwise(40 + 2 * out + (F.col("cents") % 256) / 32)

    def span(station, first, last):
        within = F.col("ts").between(F.to_timestamp(F.lit(first)), F.to_timestamp(F.lit(last)))
        return within if station is None else within & (F.col("station_id") == station)

    day = F.dayofmonth("ts") * 24 + F.hour("ts")
    temp = F.when(span("ST-2", "2024-01-15 00:00:00", "2024-01-16 23:00:00"), 20 + (day - 15 * 24) * 0.25).when(span(None, "2024-01-20 06:00:00", "2024-01-20 10:00:00"), temp - 8).otherwise(temp)
    pressure = F.when(span("ST-3", "2024-01-10 00:00:00", "2024-01-11 12:00:00"), 1001.0).otherwise(pressure)
    rh = F.when(span("ST-5", "2024-01-12 00:00:00", "2024-01-12 20:00:00"), 99.0).when(span("ST-6", "2024-01-13 00:00:00", "2024-01-13 20:00:00"), 55.0).otherwise(rh)
    return e.select("station_id", "ts", "event_id", temp.cast("double").alias("temp_c"), pressure.cast("double").alias("pressure_hpa"), rh.cast("double").alias("rh_pct"))


def suppliers_as_stations(supplier: DataFrame, below: int | None = 8) -> DataFrame:
    """STATIONS from the supplier table."""
    rows = supplier if below is None else supplier.where(F.col("s_suppkey") < below)
    k = F.col("s_suppkey")
    return rows.select(F.concat(F.lit("ST-"), (k + 1).cast("string")).alias("station_id"), F.col("s_name").alias("name"), (28 + (k * 37 % 64) / 128).alias("lat"), (77 + (k * 11 % 64) / 128).alias("lon"))
