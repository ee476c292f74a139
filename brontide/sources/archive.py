"""Hourly readings from an archive service over HTTP, as a data source of its own: a partition for each station and year."""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request
from collections.abc import Iterator
from datetime import UTC, date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from brontide.config import VARIABLES
from brontide.sources.readings import READINGS

#: The names that the service gives to the variables.
FIELDS = {"temp_c": "temperature_2m", "pressure_hpa": "pressure_msl", "rh_pct": "relative_humidity_2m"}


class Span(InputPartition):
    def __init__(self, station_id: str, lat: float, lon: float, first: str, last: str):
        self.station_id, self.lat, self.lon, self.first, self.last = station_id, lat, lon, first, last


def years(first: str, last: str) -> list[tuple[str, str]]:
    a, b = date.fromisoformat(first), date.fromisoformat(last)
    return [(max(a, date(y, 1, 1)).isoformat(), min(b, date(y, 12, 31)).isoformat()) for y in range(a.year, b.year + 1)]


def rows_of(body: bytes, station_id: str) -> Iterator[tuple]:
    """READINGS of a payload of parallel arrays; its times are UTC, whatever the session's zone."""
    hourly = json.loads(body)["hourly"]
    number = lambda x: None if x is None else float(x)
    for at, *values in zip(hourly["time"], *(hourly[FIELDS[v]] for v in VARIABLES), strict=True):
        t = datetime.fromisoformat(at)
        yield (station_id, (t if t.tzinfo else t.replace(tzinfo=UTC)).astimezone(UTC), *map(number, values))


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.url, self.stations = options["url"], json.loads(options["stations"])
        self.first, self.last = options["start"], options["end"]
        self.tries, self.pause, self.timeout = int(options.get("tries", 3)), float(options.get("pause", 1.0)), float(options.get("timeout", 60))
        self.skip = options.get("onFailure", "skip") == "skip"

    def partitions(self) -> list[Span]:
        return [Span(s["station_id"], s["lat"], s["lon"], a, b) for s in self.stations for a, b in years(self.first, self.last)]

    def read(self, partition: Span) -> Iterator[tuple]:
        """The rows of a station's year. What still fails after all tries gives no rows, or fails the job if so asked."""
        asked = {"latitude": partition.lat, "longitude": partition.lon, "start_date": partition.first, "end_date": partition.last, "hourly": ",".join(FIELDS.values()), "timezone": "UTC"}
        for k in range(self.tries):
            try:
                with urllib.request.urlopen(f"{self.url}?{urllib.parse.urlencode(asked)}", timeout=self.timeout) as reply:
                    return iter(list(rows_of(reply.read(), partition.station_id)))
            except (OSError, ValueError, KeyError, TypeError):
                if k + 1 < self.tries:
                    time.sleep(self.pause * 2**k)
                elif not self.skip:
                    raise
        return iter(())


class ArchiveSource(DataSource):
    """Options: url, stations (JSON of station_id, lat, lon), start and end (days, both inclusive), tries, pause (seconds, doubled each time), timeout, onFailure (skip or fail)."""

    @classmethod
    def name(cls) -> str:
        return "hourly_archive"

    def schema(self) -> str:
        return READINGS

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def fetch(spark: SparkSession, url: str, stations: list[dict], start: str, end: str, **options) -> DataFrame:
    """READINGS of the stations; a station of which a year fails has the others, and ``land`` leaves it out if too little is covered."""
    spark.dataSource.register(ArchiveSource)
    places = json.dumps([{k: s[k] for k in ("station_id", "lat", "lon")} for s in stations])
    given = {"url": url, "stations": places, "start": start, "end": end} | {k: str(v) for k, v in options.items()}
    return spark.read.format(ArchiveSource.name()).options(**given).load()
