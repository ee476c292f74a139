"""The detector over a stream of readings: keyed state per station, neighbours' hours joined within it, trust as keyed state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from brontide.config import VARIABLES
from brontide.functions.scalars import dewpoint_c
from brontide.operators import heal, physics, spatial
from brontide.plans import detect
from brontide.streaming.station import OUT, StationProcessor, TrustProcessor

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def routed(readings: DataFrame, edges: DataFrame, clim: DataFrame, keep: tuple = ()) -> DataFrame:
    """Each reading with its climatology, once for its own station (home) and once for each station it is a neighbour of.

    The climatology and the edges are tables that do not grow with the readings; joins with a stream keep them as they are.
    """
    usual = clim.groupBy("station_id", "month", "hour").agg(*[F.max(F.when(F.col("variable") == v, F.col(c))).alias(f"{c}_{v}") for c in ("mean", "std") for v in VARIABLES])
    hood = edges.groupBy("station_id").agg(F.sort_array(F.collect_set("neighbour_id")).alias("hood"))
    homes = edges.groupBy(F.col("neighbour_id").alias("station_id")).agg(F.collect_set("station_id").alias("homes"))
    tick = F.coalesce("tick", F.lit(False)) if "tick" in readings.columns else F.lit(False)
    kept = F.to_json(F.struct(*keep)) if keep else F.lit(None).cast("string")
    x = readings.select("station_id", "ts", *[F.col(v).cast("double").alias(v) for v in VARIABLES], tick.alias("tick"), kept.alias("kept"), F.month("ts").alias("month"), F.hour("ts").alias("hour"))
    x = x.withColumn("dewpoint", dewpoint_c(F.col("temp_c"), F.col("rh_pct"))).join(usual, ["station_id", "month", "hour"], "left").drop("month", "hour")
    x = x.join(hood, "station_id", "left").join(homes, "station_id", "left")
    return x.withColumn("home", F.explode(F.array_union(F.array("station_id"), F.coalesce("homes", F.array().cast("array<string>"))))).drop("homes")


def signals_stream(readings: DataFrame, edges: DataFrame, clim: DataFrame, keep: dict | None = None, late_h: int = 0, patience_h: int = 24) -> DataFrame:
    """What ``detect.signals`` says of each sensor and hour, from a stream of readings, with late: readings whose hour was judged before they came.

    A station's hour is judged once it and all of its neighbours are two hours and ``late_h`` further, by which readings may be out of order, or most
    of them are ``patience_h`` further than that. Clocks are kept for each station, so one that is ahead holds up or drops no hour of others. A row with
    ``tick`` moves its station's clock only.
    keep: columns of the readings to carry along, and their types.
    """
    keep = keep or {}
    x = routed(readings, edges, clim, tuple(keep)).groupBy("home").transformWithStateInPandas(statefulProcessor=StationProcessor(late_h, patience_h), outputStructType=OUT, outputMode="append", timeMode="None")
    none = lambda c: F.when(~F.isnan(c), F.col(c)) if dict(x.dtypes)[c] == "double" else F.col(c)
    x = x.select(*[none(c).alias(c) for c in x.columns if c != "kept"], *[F.from_json("kept", ", ".join(f"{k} {t}" for k, t in keep.items()))[c].alias(c) for c in keep])
    x = x.withColumn("anomaly", F.col("value") - F.col("mean")).withColumn("dev_sigma", F.try_divide(F.col("anomaly"), F.col("std")))
    return spatial.judge_around(physics.check_physics(physics.rule_flags(x)))


def detector_stream(readings: DataFrame, edges: DataFrame, clim: DataFrame, score, keep: dict | None = None, late_h: int = 0, patience_h: int = 24, forest=None) -> DataFrame:
    """readings (a stream) -> RESULT and late; score: signals -> signals with ml_score (and features, where a forest explains them)."""
    x = detect.findings(score(signals_stream(readings, edges, clim, keep, late_h, patience_h)), forest, ("late",))
    x = x.withColumn("change", F.when(F.col("late"), 0.0).otherwise(heal.trust_change()))
    schema = StructType([*[f for f in x.schema.fields if f.name != "change"], StructField("trust", DoubleType())])
    x = x.groupBy("station_id", "variable").transformWithStateInPandas(statefulProcessor=TrustProcessor(), outputStructType=schema, outputMode="append", timeMode="None")
    double = {f.name for f in schema.fields if isinstance(f.dataType, DoubleType)}
    return x.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c in double else F.col(c) for c in (*detect.RESULT, "late")])


def detect_stream(spark: SparkSession, source: str, schema: str, edges: DataFrame, clim: DataFrame, score, folder: str, keep: dict | None = None, late_h: int = 0, patience_h: int = 24, forest=None) -> DataFrame:
    """Run the detector over a folder of parquet readings, file by file, to its end, and read its results; late readings are in ``late`` beside them.

    Every batch writes under its number, so one that runs again overwrites its own. Hours that still wait for
    neighbours stay in the state, and a later run over the same folder goes on from there.
    """

    def put(batch: DataFrame, k: int) -> None:
        batch = batch.persist()
        batch.where("not late").drop("late").write.mode("overwrite").parquet(f"{folder}/results/batch={k}")
        batch.where("late").select("station_id", "ts", "variable", "value").write.mode("overwrite").parquet(f"{folder}/late/batch={k}")
        batch.unpersist()

    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, ROCKS)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        out = detector_stream(stream, edges, clim, score, keep, late_h, patience_h, forest)
        out.writeStream.foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return spark.read.parquet(f"{folder}/results").drop("batch")
