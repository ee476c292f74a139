"""A replay of a record: a cursor on its hours that jumps and moves on, with the results it keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brontide.config import CONFIG
from brontide.plans import detect
from brontide.sources.folders import written


class Cursor:
    """The detector's results up to now over ``readings``, which may be changed between moves.

    Hours are those of the record, whatever stations have them. A jump starts anew ``warmup`` hours back, with trust as
    for new sensors; moving on adds hours and carries trust. Results of the last ``keep_h`` hours stay. Every move writes its results, so plans
    stay short. history_h: hours of readings that a move looks back on, all without one.
    """

    def __init__(self, readings: DataFrame, edges: DataFrame, clim: DataFrame, score, keep: tuple = (), warmup: int = 24, keep_h: int = 7 * 24, history_h: int | None = None):
        self.readings, self.edges, self.clim, self.score, self.keep = readings, edges, clim, score, keep
        self.warmup, self.keep_h, self.history_h = warmup, keep_h, history_h
        self.now = self.results = None

    def _hours(self, where, most: int, newest: bool = False) -> list:
        """The first, or last, hours of the record that meet a condition."""
        rows = self.readings.where(where).select("ts").distinct().orderBy(F.desc("ts") if newest else "ts").limit(most).collect()
        return sorted(r["ts"] for r in rows)

    @property
    def at_end(self) -> bool:
        return not self._hours(F.col("ts") > F.lit(self.now), 1)

    def _judge(self, first, last, start: DataFrame | None) -> DataFrame:
        seconds, t = F.unix_timestamp("ts"), lambda x: F.unix_timestamp(F.lit(x))
        near = self.readings.where(seconds <= t(last) + CONFIG["window_h"] * 3600)
        if self.history_h is not None:
            near = near.where(seconds > t(first) - self.history_h * 3600)
        return detect.verdicts(detect.judged(near, self.edges, self.clim, self.score, self.keep).where((F.col("ts") >= F.lit(first)) & (F.col("ts") <= F.lit(last))), start)

    def jump(self, ts) -> None:
        """To the first hour from ts on that has the warm-up before it, or to the last of the record."""
        at = F.lit(ts).cast("timestamp")
        warm = self._hours(F.lit(True), self.warmup + 1)[-1]
        self.now = (self._hours(F.col("ts") >= F.greatest(at, F.lit(warm)), 1) or self._hours(F.lit(True), 1, newest=True))[0]
        first = self._hours(F.col("ts") <= F.lit(self.now), self.warmup + 1, newest=True)[0]
        self.results = written(self._judge(first, self.now, None))

    def advance(self, hours: int = 1) -> None:
        """On by some hours of the record, as far as there are any."""
        coming = self._hours(F.col("ts") > F.lit(self.now), hours)
        if not coming:
            return
        trust = self.results.groupBy("station_id", "variable").agg(F.max_by("trust", "ts").alias("trust"))
        new = self._judge(coming[0], coming[-1], trust)
        self.now = coming[-1]
        both = self.results.unionByName(new)
        self.results = written(both.where(F.unix_timestamp("ts") > F.unix_timestamp(F.lit(self.now)) - self.keep_h * 3600))
