"""Changes laid over readings while they are replayed: faults and storms from the next hour on, and their removal.

The readings stay as they are. Each action writes the few rows that it changes, under a version of its own, and reading
merges them: of a station's hour the highest version since the last removal counts.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brontide.config import CONFIG
from brontide.operators.inject import EVENTS, add_labels, inject_faults, inject_storm, next_event_id
from brontide.sources.folders import shared_folder

#: Hours around a storm's start in which a station takes no second one.
APART_H = 8


class Overlay:
    """Labelled readings with changes by version; every change is a written table of whole rows."""

    def __init__(self, readings: DataFrame, stations: DataFrame):
        self.clean, self.stations = add_labels(readings), stations
        self.folder = f"{shared_folder(readings.sparkSession)}/{uuid.uuid4().hex}"
        self.versions: list[int] = []
        self.made = 0

    def readings(self) -> DataFrame:
        """The readings with all changes since the last removal."""
        if not self.versions:
            return self.clean
        rest = [c for c in self.clean.columns if c not in ("station_id", "ts")]
        paths = [f"{self.folder}/version={k}" for k in self.versions]
        changed = self.clean.sparkSession.read.option("basePath", self.folder).parquet(*paths)
        last = changed.groupBy("station_id", "ts").agg(F.max_by(F.struct(*rest), "version").alias("_new"))
        x = self.clean.join(last, ["station_id", "ts"], "left")
        return x.select("station_id", "ts", *[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in rest]).select(self.clean.columns)

    def next_hour(self, now):
        """The first hour of the record after now, or its last one."""
        r = self.clean.agg(F.min(F.when(F.col("ts") > F.lit(now).cast("timestamp"), F.col("ts"))).alias("t"), F.max("ts").alias("last")).first()
        return r["t"] or r["last"]

    def _put(self, changed: DataFrame) -> None:
        self.made += 1
        changed.select(self.clean.columns).write.parquet(f"{self.folder}/version={self.made}")
        self.versions.append(self.made)

    def _fault(self, rows: DataFrame, station: str, variable: str, kind: str, t, hours: int, magnitude: float) -> None:
        # the event's rows alone are read and written
        own = rows.where((F.col("station_id") == station) & (F.col("ts") >= F.lit(t)) & (F.unix_timestamp("ts") < F.unix_timestamp(F.lit(t)) + hours * 3600))
        event = rows.sparkSession.createDataFrame([(next_event_id(rows, kind), station, variable, kind, t, hours, magnitude)], EVENTS)
        self._put(inject_faults(own, event))

    def inject_spike(self, now, station: str, target: float = 55.0):
        """The next hour's temperature becomes the target; None, and nothing changes, where there is no value then."""
        t, rows = self.next_hour(now), self.readings()
        r = rows.where((F.col("station_id") == station) & (F.col("ts") == F.lit(t))).select("temp_c").first()
        if r is None or r[0] is None:
            return None
        self._fault(rows, station, "temp_c", "SPIKE", t, 1, target - r[0])
        return t

    def inject_freeze(self, now, station: str, variable: str = "rh_pct", hours: int = 12):
        t = self.next_hour(now)
        self._fault(self.readings(), station, variable, "FROZEN", t, hours, 0.0)
        return t

    def inject_storm(self, now, station: str, strength: float = 1.2):
        """A front that leaves the station in the next hour; None, and nothing changes, where a storm is at the station within ``APART_H`` hours."""
        t, rows, s = self.next_hour(now), self.readings(), CONFIG["storm"]
        away = F.unix_timestamp("ts") - F.unix_timestamp(F.lit(t))
        if rows.where((F.col("station_id") == station) & (F.abs(away) <= APART_H * 3600) & F.col("event_id").startswith("STORM")).limit(1).count():
            return None
        length = s["onset_h"] + s["relax_h"] + math.ceil(s["radius_km"] / s["speed_kmh"])
        name = next_event_id(rows, "STORM")
        stormy = inject_storm(rows.where((away >= 0) & (away <= length * 3600)), self.stations, station, t, name, strength)
        self._put(stormy.where(F.col("event_id") == name))
        return t

    def clear(self) -> None:
        """The readings are as they were; what was written stays under its versions, but no longer counts."""
        self.versions = []

