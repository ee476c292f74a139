"""Hour-by-hour results as a stream: trust as keyed state, counts in event-time windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from brontide.config import CONFIG
from brontide.operators.heal import trust_change

TRUST = "station_id string, variable string, ts timestamp, trust double"


def trust_stream(results: DataFrame) -> DataFrame:
    """results (a stream of station_id, variable, ts, status, severity, hours in order of arrival) -> TRUST.

    The state of a sensor is one number; it equals the batch fold as long as hours arrive in order.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else CONFIG["trust_start"]
        rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
        out = []
        for d in rows["d"]:
            now = min(max(now + d, 0.0), 100.0)
            out.append(now)
        state.update((now,))
        yield pd.DataFrame({"station_id": key[0], "variable": key[1], "ts": rows["ts"].to_numpy(), "trust": out})

    keyed = results.select("station_id", "variable", "ts", trust_change().alias("d"))
    return keyed.groupBy("station_id", "variable").applyInPandasWithState(run, TRUST, "trust double", "append", GroupStateTimeout.NoTimeout)


def flagged_per_day(results: DataFrame, late: str = "2 hours") -> DataFrame:
    """Counts of flagged rows by day of event time; a day closes when the watermark passes it."""
    flagged = results.where(F.col("status").isin("SENSOR_FAULT", "SUSPECT"))
    return flagged.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("day")).agg(F.count("*").alias("flagged")).select(F.col("day.start").alias("day"), "flagged")


def replay(spark, source: str, schema: str, checkpoint: str, sink: str, step=trust_stream) -> DataFrame:
    """Run ``step`` over a folder of parquet results to its end, one file at a time, and read what it wrote."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = step(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(sink)
