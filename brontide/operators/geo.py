"""Neighbours by distance: candidates come from cells of a grid, so no pairs are made beyond the radius's surroundings.

Stations at one place share its distances: a distance is worked out once for two places, not for all their stations.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brontide.config import CONFIG
from brontide.functions.scalars import haversine_km
from brontide.sources.folders import written

#: Kilometres of one degree of latitude at R = 6371.
DEGREE = math.pi * 6371.0 / 180
#: So many stations make a block at most; blocks of adjacent cells are what tasks are dealt. A task holds all pairs of
#: two blocks before it passes them on, so they must stay few.
BLOCK = 256
#: So many members of a place at most, and so many of those that it ranks, make a tile.
TILE = 1024


def _high(radius_km: float) -> float:
    """Degrees of latitude of a band: a radius, and a little more, as distances are rounded."""
    return radius_km / DEGREE * (1 + 1e-6)


def _cell(lon: Column, b: Column, high) -> tuple[Column, Column]:
    """The cell of a longitude in band b, before it is wrapped, and the number of cells of the band."""
    high = F.lit(high)
    edge = F.greatest(F.abs(b - 1), F.abs(b + 2)) * high
    # degrees of longitude of a radius at the outer edge of the bands around b; around a pole all longitudes are near
    width = F.when(edge >= 90, F.lit(360.0)).otherwise(F.least(high / F.cos(F.radians(edge)), F.lit(360.0)))
    count = F.greatest(F.floor(360 / width), F.lit(1))
    return F.floor((lon + 180) / (360 / count)), count


def _blocks(posted: DataFrame, name: str) -> DataFrame:
    """b, c, name: the stations of a cell in blocks, each place with its ids. One deal by cell serves all of it.

    Blocks are cut from the stations in order of places, so that a block of a crowded cell holds few places.
    """
    n = F.row_number().over(Window.partitionBy("b", "c").orderBy("lat", "lon", "station_id"))
    dealt = posted.withColumn("block", F.floor((n - 1) / BLOCK))
    places = dealt.groupBy("b", "c", "block", "lat", "lon").agg(F.collect_list("station_id").alias("ids"))
    return places.groupBy("b", "c", "block").agg(F.collect_list(F.struct("lat", "lon", "ids")).alias(name)).drop("block")


def _spread(df: DataFrame, *key: str) -> DataFrame:
    """Few short rows that become many: dealt to as many tasks as a shuffle has, by key if there is one."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)


def _near(seekers: DataFrame, stations: DataFrame, radius_km: float, digits: int | None = None) -> DataFrame:
    """station_id, lat, lon of seekers with neighbour_id, lat2, lon2 of stations within the radius, and distance_km.

    Cells are bands of latitude one radius high, split by longitude in steps that span a radius at the band's
    latitude nearest the pole, wrapped at the date line; a pair within the radius lies in adjacent cells. A station
    that seeks meets itself, too.
    """
    high, rows = _high(radius_km), ["station_id", "lat", "lon"]
    band = F.floor(F.col("lat") / high)
    # a station is posted in its own cell; a seeker looks into the 3 x 3 cells around it, each band by its own width
    cell, count = _cell(F.col("lon"), F.col("b"), high)
    seek = seekers.select(*rows, F.explode(F.array(band - 1, band, band + 1)).alias("b"))
    seek = seek.select(*rows, "b", F.explode(F.array_distinct(F.array(*[F.pmod(cell + k, count) for k in (-1, 0, 1)]))).alias("c"))
    home = stations.select(*rows, band.alias("b")).withColumn("c", F.pmod(cell, count))
    met = _spread(_blocks(seek, "seek").join(_blocks(home, "home"), ["b", "c"]).select("seek", "home"))
    pairs = met.select(F.explode("seek").alias("s"), "home").select("s", F.explode("home").alias("h"))
    d = haversine_km(F.col("s.lat"), F.col("s.lon"), F.col("h.lat"), F.col("h.lon"))
    pairs = pairs.where(d <= radius_km).withColumn("distance_km", d if digits is None else F.round(d, digits))
    ends = pairs.select(F.explode("s.ids").alias("station_id"), "s", "h", "distance_km")
    return ends.select("station_id", "s.lat", "s.lon", F.explode("h.ids").alias("neighbour_id"), F.col("h.lat").alias("lat2"), F.col("h.lon").alias("lon2"), "distance_km")


def neighbour_edges(stations: DataFrame, radius_km: float = CONFIG["radius_km"], digits: int | None = 1, seekers: DataFrame | None = None) -> DataFrame:
    """station_id, neighbour_id, distance_km (to 0.1 km, after the test), for all pairs within the radius, or those of the seekers."""
    s = stations.where(F.col("station_id").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    asking = s if seekers is None else s.join(seekers.select("station_id"), "station_id", "left_semi")
    return _near(asking, s, radius_km, digits).where(F.col("station_id") != F.col("neighbour_id")).select("station_id", "neighbour_id", "distance_km")


def nearest_first(edges: DataFrame) -> DataFrame:
    """edges with place: 1 for a station's nearest neighbour; of equally far ones the lesser name comes first."""
    return edges.withColumn("place", F.row_number().over(Window.partitionBy("station_id").orderBy("distance_km", "neighbour_id")))


def neighbours_ranked(stations: DataFrame, radius_km: float = CONFIG["radius_km"], digits: int | None = None) -> DataFrame:
    """nearest_first of all pairs within the radius; distances are rounded to digits after they are ranked.

    Stations at one place have one ranking, in which each leaves out itself, so it is made once for the place. Names
    that come more than once, and stations alone at their place, have rankings of their own.
    """
    s = stations.where(F.col("station_id").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    here, named = F.count("*").over(Window.partitionBy("lat", "lon")), F.count("*").over(Window.partitionBy("station_id"))
    s = written(s.select("station_id", "lat", "lon").withColumn("here", here).withColumn("shared", (named == 1) & (F.col("here") > 1)))
    shown = F.col("distance_km") if digits is None else F.round("distance_km", digits)
    own = nearest_first(neighbour_edges(s, radius_km, None, s.where("not shared"))).withColumn("distance_km", shown)

    members = s.where("shared").select("station_id", "lat", "lon")
    places = written(members.select("lat", "lon").distinct().withColumn("spot", F.monotonically_increasing_id()))
    order = Window.partitionBy("spot").orderBy("distance_km", "neighbour_id")
    near = _near(places.withColumnRenamed("spot", "station_id"), s, radius_km).withColumnRenamed("station_id", "spot")
    ranking = written(near.select("spot", "neighbour_id", F.row_number().over(order).alias("n"), shown.alias("km")))
    # a member's own row of its place's ranking: its name comes once
    self = ranking.select(F.col("neighbour_id").alias("station_id"), "spot", F.col("n").alias("self"))
    ranks = members.join(places, ["lat", "lon"]).select("station_id", "spot").join(self, ["station_id", "spot"])

    # members and ranking of a place meet in tiles, so that many tasks share them however many stations a place has
    tile = lambda c: F.floor(F.col(c) / TILE)
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c)))
    homes, theres = ranks.groupBy("spot").agg(F.max(tile("self")).alias("homes")), ranking.groupBy("spot").agg(F.max(tile("n")).alias("theres"))
    askers = _spread(ranks.join(theres, "spot")).select("spot", tile("self").alias("home"), upto("theres").alias("there"), "station_id", "self")
    # places in a ranking follow each other, so of a run of one distance the first says the others
    runs = ranking.groupBy("spot", tile("n").alias("there"), "km").agg(F.min("n").alias("first"), F.sort_array(F.collect_list(F.struct("n", "neighbour_id"))).alias("run"))
    runs = _spread(runs.join(homes, "spot")).select("spot", upto("homes").alias("home"), "there", "km", "first", F.col("run.neighbour_id").alias("names"))
    key = ["spot", "home", "there"]
    # a merge join goes through askers one by one, so a task holds the rows of one asker and one tile at a time
    met = _spread(askers, *key).join(_spread(runs, *key).hint("merge"), key)
    pairs = met.select("station_id", "self", "km", "first", F.posexplode("names").alias("pos", "neighbour_id"))
    n = F.col("first") + F.col("pos")
    pairs = pairs.where(F.col("self") != n).select("station_id", "neighbour_id", F.col("km").alias("distance_km"), (n - (F.col("self") < n).cast("int")).alias("place"))
    return own.unionByName(pairs)


def _first_radius(stations: DataFrame, radius_km: float, share: int = 1000) -> float:
    """The radius, halved until pairs in one cell are at most `share` times the stations, or 17 times."""
    high = F.lit(_high(radius_km)) / F.pow(F.lit(2.0), F.col("j"))
    at = stations.select("lat", "lon", F.explode(F.sequence(F.lit(0), F.lit(17))).alias("j")).withColumn("b", F.floor(F.col("lat") / high))
    cells = at.groupBy("j", "b", _cell(F.col("lon"), F.col("b"), high)[0].alias("c")).count()
    sums = cells.groupBy("j").agg(F.sum(F.col("count").cast("double") * F.col("count")).alias("pairs"), F.sum("count").alias("n"))
    j = sums.where((F.col("pairs") <= share * F.col("n")) | (F.col("j") == 17)).agg(F.min("j")).first()[0]
    return radius_km / 2 ** (j or 0)


def _nearest(seekers: DataFrame, key: list[str], stations: DataFrame, k: int, radius_km: float) -> DataFrame:
    """key, neighbour_id, n: the k stations of other names nearest to each of the seekers by distance and name.

    Those with k within the radius are done, as all others lie beyond; the rest look twice as far, up to half around the globe.
    """
    w = Window.partitionBy(*key).orderBy("distance_km", "neighbour_id")
    left, out = seekers, None
    while True:
        pairs = _near(left, stations, radius_km).where(F.col("station_id") != F.col("neighbour_id"))
        near = written(pairs.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).select(*key, "neighbour_id", "n"))
        done = near.groupBy(*key).count().where(F.col("count") >= k).drop("count")
        last = radius_km >= math.pi * 6371.0
        found = near if last else near.join(done, key, "left_semi")
        out = found if out is None else out.unionByName(found)
        left = written(left.join(done, key, "left_anti").select("station_id", "lat", "lon"))
        if last or left.isEmpty():
            return out
        radius_km *= 2


def nearest_links(stations: DataFrame, k: int = 3, radius_km: float = CONFIG["radius_km"]) -> DataFrame:
    """Undirected links (a, b) of every station to its k nearest ones, by exact distance, however far they are.

    Of a place only the k + 1 least names can be among anybody's nearest, and stations at one place have the same
    k + 1 nearest, themselves among them. Where stations are dense, looking around starts with less than the radius.
    Names that come more than once are looked up among all stations.
    """
    s = stations.where(F.col("station_id").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull()).select("station_id", "lat", "lon")
    twice = written(s.groupBy("station_id").count().where("count > 1").select("station_id"))
    place = Window.partitionBy("lat", "lon").orderBy("station_id")
    few = written(s.withColumn("n", F.row_number().over(place)).where(F.col("n") <= k + 1).drop("n"))
    n = few.count()
    radius_km = _first_radius(few, radius_km) if n > 1000 else radius_km
    # a name that sorts with none: a place asks for all its stations
    places = few.groupBy("lat", "lon").agg(F.lit("\0").alias("station_id"))
    near = _nearest(places, ["lat", "lon"], few, min(k + 1, n), radius_km)
    near = near.groupBy("lat", "lon").agg(F.sort_array(F.collect_list(F.struct("n", "neighbour_id"))).alias("near"))
    others = F.slice(F.filter(F.col("near.neighbour_id"), lambda x: x != F.col("station_id")), 1, k)
    found = s.join(twice, "station_id", "left_anti").join(near, ["lat", "lon"]).select("station_id", F.explode(others).alias("neighbour_id"))
    if not twice.isEmpty():
        again = _nearest(s.join(twice, "station_id", "left_semi"), ["station_id"], s, k, radius_km)
        found = found.unionByName(again.select("station_id", "neighbour_id"))
    return found.select(F.least("station_id", "neighbour_id").alias("a"), F.greatest("station_id", "neighbour_id").alias("b")).distinct()


def map_positions(stations: DataFrame) -> DataFrame:
    """station_id, x, y: longitudes shrunk by the cosine of the mean latitude, so that distances hold around it."""
    middle = stations.agg(F.cos(F.radians(F.avg("lat"))).alias("_scale"))
    return stations.crossJoin(middle).select("station_id", (F.col("lon") * F.col("_scale")).alias("x"), F.col("lat").alias("y"))
