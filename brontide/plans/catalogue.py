"""All registered queries over sensor readings: each an operator on the driver's tables, with its SQL."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brontide.config import CONFIG, FEATURES, VARIABLES
from brontide.functions.scalars import by_variable, dewpoint_c, severity, trust_band
from brontide.operators import climatology, evaluate, fusion, geo, heal, history, ingest, inject, overlay, physics, spatial, summary
from brontide.operators import features as feats
from brontide.operators import forest as trees
from brontide.plans import detect
from brontide.plans.oracles import OFF_GRID, TS, over_injected, sql
from brontide.sources import readings as src
from brontide.sources.folders import shared_folder
from brontide.streaming.cursor import Cursor
from brontide.streaming.detector import detect_stream
from brontide.streaming.replay import replay

QUERIES: dict = {}
ORACLES: dict = {}


def query(select: str | None = None, chain=sql):
    def add(f):
        QUERIES[f.__name__] = f
        if select is not None:
            ORACLES[f.__name__] = chain(select)
        return f

    return add


def _table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _readings(spark, sf_dir: str) -> DataFrame:
    return src.events_as_readings(_table(spark, sf_dir, "events"))


def _raw(spark, sf_dir: str) -> DataFrame:
    """The readings at the times of their events, which are on no grid."""
    times = _table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("at"))
    return _readings(spark, sf_dir).join(times, "event_id").select("station_id", F.col("at").alias("ts"), "event_id", *VARIABLES)


def _stations(spark, sf_dir: str, below: int | None = 8) -> DataFrame:
    return src.suppliers_as_stations(_table(spark, sf_dir, "supplier"), below)


def _edges(spark, sf_dir: str) -> DataFrame:
    return geo.neighbour_edges(_stations(spark, sf_dir))


def _long(spark, sf_dir: str) -> DataFrame:
    return ingest.long_form(_readings(spark, sf_dir), ("event_id",))


def _clim(spark, sf_dir: str) -> DataFrame:
    return climatology.fit_climatology(_long(spark, sf_dir))


def _anomalies(spark, sf_dir: str) -> DataFrame:
    return climatology.with_climatology(_long(spark, sf_dir), _clim(spark, sf_dir))


def _history(spark, sf_dir: str) -> DataFrame:
    return history.sensor_history(_readings(spark, sf_dir), ("event_id",))


def _physics(spark, sf_dir: str) -> DataFrame:
    return physics.check_physics(physics.rule_flags(_history(spark, sf_dir)))


def _signals(spark, sf_dir: str) -> DataFrame:
    """All signals with a fixed stand-in for the model's score."""
    s = detect.signals(_readings(spark, sf_dir), _clim(spark, sf_dir), _edges(spark, sf_dir), ("event_id",))
    return s.withColumn("ml_score", _stand_in())


def _stand_in():
    return ((F.col("event_id") * 7919 + by_variable(dict(zip(VARIABLES, (0, 1, 2), strict=True))) * 613) % 1000) / 1000.0


def _results(spark, sf_dir: str) -> DataFrame:
    """RESULT-shaped rows with statuses, labels and events by fixed rules, so that summaries are tested apart from the detector."""
    x = _long(spark, sf_dir)
    vi = by_variable(dict(zip(VARIABLES, (0, 1, 2), strict=True)))
    hk, e = F.dayofmonth("ts") * 24 + F.hour("ts"), F.col("event_id")
    g = (F.floor(hk / 5) + 3 * F.substring("station_id", 4, 9).cast("int") + vi) % 11
    third, storm = F.floor(hk / 5) % 3, F.floor(hk / 7) % 9 == 2
    return x.select(
        "station_id", "ts", "variable", "value",
        F.when(g == 0, "SENSOR_FAULT").when(g == 1, "SUSPECT").when(storm & (vi < 2), "GENUINE_EVENT").otherwise("NORMAL").alias("status"),
        F.when(third == 0, "SPIKE").when(third == 1, "FROZEN").alias("fault_type"),
        F.element_at(F.array(*map(F.lit, ("LOW", "MEDIUM", "HIGH", "CRITICAL"))), (e % 4 + 1).cast("int")).alias("severity"),
        ((e % 50) / 64).alias("confidence"), (F.col("value") + (e % 7) / 8).alias("corrected_value"), ((e * 13 + vi * 29) % 101).cast("double").alias("trust"),
        F.when(e % 10 < 3, F.when(third == 0, "SPIKE").when(third == 1, "FROZEN").otherwise("DRIFT")).otherwise("NONE").alias("label"),
        F.when(storm, "STORM_001").when(e % 10 < 3, F.concat(F.lit("F_"), F.floor(hk / 5).cast("string"))).otherwise("").alias("event_id"),
        (F.col("value") - 0.25).alias("true_value"),
        F.array(F.concat(F.lit("reason "), F.col("variable"), F.lit(" "), (e % 13).cast("string"))).alias("reasons"),
        F.struct(F.when(e % 4 == 0, 1.0).when(e % 4 == 1, 0.5).otherwise(0.0).alias("physics"), ((e * 7919 + vi * 613) % 1000 / 1000.0).alias("iforest"), F.when(e % 5 > 0, (e % 9 - 4).cast("double")).alias("spatial_z")).alias("scores"),
    )


def _now(results: DataFrame):
    return F.lit(results.agg(F.max("ts")).first()[0])


def _out(df: DataFrame, *columns, ts: str | None = "ts") -> DataFrame:
    time = [F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias("ts")] if ts else []
    return df.select(*[c for c in ("station_id",) if c in df.columns and ts], *time, *columns)


def _r(name: str, as_name: str | None = None, digits: int = 6):
    return F.round(name, digits).alias(as_name or name)


TIME = "yyyy-MM-dd HH:mm:ss"


def _time(c: str):
    return F.date_format(c, TIME).alias(c)


@query(rf"select station_id, {TS}, temp_c, pressure_hpa, rh_pct from readings where ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-13'")
def q_split_filter(spark, d):
    return _out(ingest.select_split(_readings(spark, d), "2024-01-05", "2024-01-12"), *VARIABLES)


@query(rf"select station_id, {TS}, event_id from readings")
def q_dedupe_first(spark, d):
    return _out(_readings(spark, d), "event_id")


_GRID = """, grid as (select station_id, unnest(generate_series(min(ts), max(ts), interval 1 hour)) ts from readings group by 1), g as (select grid.station_id, grid.ts, temp_c, pressure_hpa, rh_pct from grid left join readings using (station_id, ts)),
gl as (select *, count(*) over (partition by station_id, run) gap0 from (select *, sum(case when lag_missing = (temp_c is null) then 0 else 1 end) over (partition by station_id order by ts) run from (select *, lag(temp_c is null) over (partition by station_id order by ts) lag_missing from g)))"""


@query(_GRID + rf" select station_id, {TS}, temp_c, rh_pct from g")
def q_hourly_grid(spark, d):
    return _out(ingest.hourly_grid(_readings(spark, d)), "temp_c", "rh_pct")


@query(_GRID + rf" select station_id, {TS}, case when temp_c is null then gap0 else 0 end gap from gl")
def q_gap_length(spark, d):
    return _out(ingest.gap_lengths(ingest.hourly_grid(_readings(spark, d)), "temp_c"), F.col("gap").cast("long").alias("gap"))


def _filled(v: str) -> str:
    w = "over (partition by station_id order by ts rows between"
    pair = f"case when {v} is not null then struct_pack(n := n, v := {v}) end ignore nulls"
    return f"last_value({pair}) {w} unbounded preceding and current row) a_{v}, first_value({pair}) {w} current row and unbounded following) b_{v}"


_GAPS = ", ".join(f"case when {v} is null then count(*) over (partition by station_id, run_{v}) end gap_{v}" for v in VARIABLES)
_STARTS = ", ".join(f"sum(f_{v}) over (partition by station_id order by ts) run_{v}" for v in VARIABLES)
_TURNS = ", ".join(f"case when lag({v} is null) over (partition by station_id order by ts) = ({v} is null) then 0 else 1 end f_{v}" for v in VARIABLES)
_VALUES = ", ".join(f"round(case when {v} is not null then {v} when gap_{v} <= 2 then a_{v}.v + (b_{v}.v - a_{v}.v) * (n - a_{v}.n) / (b_{v}.n - a_{v}.n) end, 6) {v}" for v in VARIABLES)


@query(_GRID + rf""", t as (select *, {_TURNS}, row_number() over (partition by station_id order by ts) n from g), u as (select *, {_STARTS} from t), v as (select *, {_GAPS} from u), p as (select *, {", ".join(map(_filled, VARIABLES))} from v)
select station_id, {TS}, {_VALUES} from p""")
def q_interpolate(spark, d):
    return _out(ingest.interpolate(ingest.hourly_grid(_readings(spark, d))), *map(_r, VARIABLES))


@query("select station_id, round(count(temp_c) / count(*), 6) temp_c, round(count(pressure_hpa) / count(*), 6) pressure_hpa, round(count(rh_pct) / count(*), 6) rh_pct, least(count(temp_c), count(pressure_hpa), count(rh_pct)) / count(*) >= 0.8 kept from readings group by 1")
def q_coverage(spark, d):
    return src.coverage(_readings(spark, d)).select("station_id", *[_r(v) for v in VARIABLES], "kept")


@query("select station_id, m as month, hr as hour, variable, round(mean, 6) mean, round(std, 9) std from clim")
def q_climatology(spark, d):
    return _clim(spark, d).select("station_id", F.col("month").cast("long").alias("month"), F.col("hour").cast("long").alias("hour"), "variable", _r("mean"), _r("std", digits=9))


@query(rf"select station_id, {TS}, variable, round(anomaly, 6) anomaly from anom")
def q_anomaly(spark, d):
    return _out(_anomalies(spark, d), "variable", _r("anomaly"))


@query(rf"select station_id, {TS}, variable, round(dev_sigma, 6) dev_sigma from anom")
def q_dev_sigma(spark, d):
    return _out(_anomalies(spark, d), "variable", _r("dev_sigma"))


@query("select station_id, case when abs(coalesce(dev_sigma, 0)) >= 10 then 'CRITICAL' when abs(coalesce(dev_sigma, 0)) >= 6 then 'HIGH' when abs(coalesce(dev_sigma, 0)) >= 3 then 'MEDIUM' else 'LOW' end severity, count(*) n from anom group by all")
def q_severity(spark, d):
    return _anomalies(spark, d).groupBy("station_id", severity(F.col("dev_sigma")).alias("severity")).agg(F.count("*").alias("n"))


@query("select station_id, neighbour_id, round(km, 1) distance_km from pairs where km <= 20")
def q_haversine_edges(spark, d):
    return geo.neighbour_edges(_stations(spark, d, None), 20.0)


@query("select distinct least(station_id, neighbour_id) a, greatest(station_id, neighbour_id) b from (select * from pairs qualify row_number() over (partition by station_id order by km, neighbour_id) <= 3)")
def q_knn_links(spark, d):
    return geo.nearest_links(_stations(spark, d, None))


@query("select station_id, round(lon * (select cos(radians(avg(lat))) from stations), 6) x, lat y from stations")
def q_map_positions(spark, d):
    return geo.map_positions(_stations(spark, d, None)).select("station_id", _r("x"), "y")


@query(rf"""select station_id, {TS}, temp_c from readings where station_id in ('ST-1', 'ST-2') and ts < (select min(ts) from readings where station_id in ('ST-1', 'ST-2')) + interval 31 day""")
def q_sample(spark, d):
    return _out(src.sample_of(_readings(spark, d)), "temp_c")


@query(rf"select station_id, {TS}, round(dewpoint, 6) dewpoint from wide")
def q_dewpoint(spark, d):
    return _out(_readings(spark, d).withColumn("dewpoint", dewpoint_c(F.col("temp_c"), F.col("rh_pct"))), _r("dewpoint"))


@query(rf"select station_id, {TS}, variable, value - lag1 diff_1, value - lag3 diff_3 from hist")
def q_deltas(spark, d):
    return _out(_history(spark, d), "variable", (F.col("value") - F.col("lag1")).alias("diff_1"), (F.col("value") - F.col("lag3")).alias("diff_3"))


@query(rf"select station_id, {TS}, variable, round(coalesce(stddev_samp(value) over (partition by station_id, variable order by ts rows 5 preceding), 0), 6) std_6, round(coalesce(stddev_samp(value) over (partition by station_id, variable order by ts rows 23 preceding), 0), 6) std_24 from lng")
def q_rolling_std(spark, d):
    return _out(feats.feature_frame(_readings(spark, d), _clim(spark, d)), "variable", _r("std_6"), _r("std_24"))


_RUN = ", rc as (select *, case when coalesce(value = lag(value) over (partition by station_id, variable order by ts), false) then 0 else 1 end fresh from lng), rn as (select *, sum(fresh) over (partition by station_id, variable order by ts) run from rc), rl as (select *, row_number() over (partition by station_id, variable, run order by ts) run_length from rn)"


@query(_RUN + rf" select station_id, {TS}, variable, run_length run from rl")
def q_same_value_run(spark, d):
    return _out(history.same_value_run(_long(spark, d)), "variable", F.col("run").cast("long").alias("run"))


_FEATURES_SQL = _RUN + rf""", ff as (select h.station_id, strftime(h.ts, '%Y-%m-%d %H:%M:%S') ts, h.variable, coalesce(h.value, 0) as value, coalesce(h.value - lag1, 0) diff_1, coalesce(h.value - lag3, 0) diff_3, run_length::double run_length, round(coalesce(dev_sigma, 0), 6) dev_sigma,
round(coalesce(h.dewpoint, 0), 6) dewpoint_value, round(coalesce(h.dewpoint - h.prev_dewpoint, 0), 6) dewpoint_delta, round(sin(2 * pi() * (hour(h.ts) + minute(h.ts) / 60) / 24), 6) + 0 hour_sin, round(cos(2 * pi() * (hour(h.ts) + minute(h.ts) / 60) / 24), 6) + 0 hour_cos, round(coalesce(stddev_samp(h.value) over w6, 0), 6) std_6, round(coalesce(stddev_samp(h.value) over w24, 0), 6) std_24 from hist h join rl using (station_id, ts, variable) window w6 as (partition by h.station_id, h.variable order by h.ts rows 5 preceding), w24 as (partition by h.station_id, h.variable order by h.ts rows 23 preceding))"""


@query(_FEATURES_SQL + " select * from ff")
def q_feature_frame(spark, d):
    f = feats.feature_frame(_readings(spark, d), _clim(spark, d))
    return _out(f, "variable", "value", "diff_1", "diff_3", "run_length", _r("dev_sigma"), _r("dewpoint_value"), _r("dewpoint_delta"), (F.round("hour_sin", 6) + 0).alias("hour_sin"), (F.round("hour_cos", 6) + 0).alias("hour_cos"), _r("std_6"), _r("std_24"))


def _rule(name: str, columns: tuple):
    select = rf"select station_id, {TS}, variable, {', '.join(columns)} from phys where {' or '.join(columns)}"

    def run(spark, d):
        return _out(physics.rule_flags(_history(spark, d)).where(reduce(lambda a, b: a | b, [F.col(c) for c in columns])), "variable", *columns)

    run.__name__ = name
    query(select)(run)


for _name, _columns in (("q_rule_missing", ("missing",)), ("q_rule_range", ("out_of_range",)), ("q_rule_roc", ("roc_soft", "roc_hard")), ("q_rule_dewpoint", ("dewpoint_max", "dewpoint_jump")), ("q_rule_flatline", ("flatline",)), ("q_rule_decoupled", ("apart",))):
    _rule(_name, _columns)


@query(rf"select station_id, {TS}, variable, is_hard, is_soft, rule_ids, fault_hint from phys")
def q_physics(spark, d):
    return _out(_physics(spark, d), "variable", F.col("hard").alias("is_hard"), F.col("soft").alias("is_soft"), F.array_join("rule_ids", ",").alias("rule_ids"), "fault_hint")


@query(rf"select station_id, {TS}, variable, round(z, 6) z, n::bigint n, off::bigint as off, consistent from spat")
def q_spatial_z(spark, d):
    a = _anomalies(spark, d)
    return _out(spatial.spatial_check(a, spatial.around(a, _edges(spark, d))), "variable", _r("z"), F.col("n").cast("long").alias("n"), F.col("offset").cast("long").alias("off"), "consistent")


@query(rf""", raw as (select a.station_id, r1.raw_ts ts, a.variable, a.value, a.anomaly, l.lo, l.hi, l.mad_floor from anom a join r1 on r1.event_id = a.event_id join limits l on l.variable = a.variable),
ask as (select r.station_id, r.ts, r.variable, r.anomaly, r.mad_floor, k as off, r.ts + to_hours(k) target, e.neighbour_id from raw r cross join (select unnest(range(-2, 3)) k) o join edges e on e.station_id = r.station_id),
hit as (select a.*, b.value, b.lo, b.hi from ask a join raw b on b.station_id = a.neighbour_id and b.variable = a.variable and b.ts >= a.target - interval 30 minute and b.ts <= a.target + interval 30 minute qualify row_number() over (partition by a.station_id, a.ts, a.variable, a.off, a.neighbour_id order by abs(epoch_us(b.ts) - epoch_us(a.target)), b.ts) = 1),
told as (select h.*, h.value - c.mean a from hit h join clim c on c.station_id = h.neighbour_id and c.m = month(h.target) and c.hr = hour(h.target) and c.variable = h.variable where h.value is not null and c.mean is not null),
st as (select station_id, ts, variable, off, any_value(anomaly) anomaly, any_value(mad_floor) mad_floor, list(a) all_a, list(a) filter (value between lo and hi) good from told group by all),
zs as (select *, case when len(all_a) >= 2 then len(all_a) end n, list_median(all_a) med from st),
zz as (select *, (anomaly - med) / (1.4826 * list_median(list_transform(all_a, lambda x: abs(x - med))) + mad_floor) z from zs),
b as (select station_id, ts, variable, z, n, off from zz where n is not null qualify row_number() over (partition by station_id, ts, variable order by abs(z) nulls first, off) = 1),
g as (select station_id, ts, variable, list_median(flatten(list(good))) near_anomaly from st group by all)
select g.station_id, strftime(g.ts, '%Y-%m-%d %H:%M:%S') ts, g.variable, round(z, 6) z, coalesce(n, 0)::bigint n, coalesce(off, -99)::bigint as off, case when n is not null then coalesce(abs(z) <= 3, false) end consistent, round(near_anomaly, 6) near_anomaly from g left join b using (station_id, ts, variable)""")
def q_spatial_asof(spark, d):
    """Readings at the times of their events, which are on no grid."""
    raw = _raw(spark, d).drop("event_id")
    s = spatial.asof_signals(raw, _clim(spark, d), _edges(spark, d))
    return _out(s, "variable", _r("z"), F.col("n").cast("long").alias("n"), F.coalesce("offset", F.lit(-99)).cast("long").alias("off"), "consistent", _r("near_anomaly"))


@query(rf"select e.station_id, strftime(n.ts, '%Y-%m-%d %H:%M:%S') ts, n.variable, quantile_cont(n.value, 0.5) median from edges e join lng n on n.station_id = e.neighbour_id join limits l on l.variable = n.variable where n.value between lo and hi group by all")
def q_neighbour_median(spark, d):
    return _out(spatial.neighbour_median(_long(spark, d).drop("event_id"), _edges(spark, d)), "variable", "median")


@query(rf"select station_id, {TS}, variable, round(residual6, case when std6 < 1000 then 6 else 2 end) residual6, round(std6, case when std6 < 1000 then 6 else 2 end) std6 from pat")
def q_detrend_noise(spark, d):
    """Six digits, or two where a sentinel makes the spread run into thousands."""
    fine = lambda c: F.when(F.col("std6") < 1000, F.round(c, 6)).otherwise(F.round(c, 2)).alias(c)
    return _out(history.pattern_columns(_history(spark, d)), "variable", fine("residual6"), fine("std6"))


@query(rf"select station_id, {TS}, variable, baseline from pat")
def q_baseline_median(spark, d):
    return _out(history.pattern_columns(_history(spark, d)), "variable", "baseline")


@query(rf"select station_id, {TS}, variable, round(usual, 6) usual from pat2")
def q_usual_spread(spark, d):
    return _out(history.usual_spread(history.pattern_columns(_history(spark, d))), "variable", _r("usual"))


@query(rf"select station_id, {TS}, variable, max_step, net_day from pat where full_day and max_step < soft and net_day > drift")
def q_drift(spark, d):
    p = history.pattern_columns(_history(spark, d))
    soft = by_variable({v: CONFIG["rate"][v][0] for v in VARIABLES})
    return _out(p.where(F.col("full_day") & (F.col("max_step") < soft) & (F.col("net_day") > by_variable(CONFIG["drift"]))), "variable", "max_step", "net_day")


@query(rf"select station_id, {TS}, variable, status, round(confidence, 4) confidence, severity from dec")
def q_decide(spark, d):
    return _out(fusion.decide(_signals(spark, d)), "variable", "status", "confidence", "severity")


@query(rf"select station_id, {TS}, variable, fault_type from fing where status <> 'NORMAL'")
def q_fingerprint(spark, d):
    return _out(fusion.fingerprint(fusion.decide(_signals(spark, d))).where("status <> 'NORMAL'"), "variable", "fault_type")


@query(rf"select station_id, {TS}, variable, round(corrected, 4) corrected_value from imp where status in ('SENSOR_FAULT', 'SUSPECT')")
def q_impute(spark, d):
    x = heal.impute(fusion.decide(_signals(spark, d)))
    return _out(x.where("status in ('SENSOR_FAULT', 'SUSPECT')"), "variable", _r("corrected_value", digits=4))


@query(rf"select station_id, {TS}, variable, trust from trust")
def q_trust(spark, d):
    return _out(heal.trust_scores(fusion.decide(_signals(spark, d))), "variable", "trust")


@query("select case when trust >= 80 then 'HEALTHY' when trust >= 50 then 'WATCH' when trust >= 25 then 'DEGRADED' else 'FAILED' end band, count(*) n from trust group by 1")
def q_trust_band(spark, d):
    return heal.trust_scores(fusion.decide(_signals(spark, d))).groupBy(trust_band(F.col("trust")).alias("band")).agg(F.count("*").alias("n"))


_DETECTED = """select f.station_id, strftime(f.ts, '%Y-%m-%d %H:%M:%S') ts, f.variable, f.status, case when f.status <> 'NORMAL' then f.fault_type end fault_type, f.severity, case when f.status in ('SENSOR_FAULT', 'SUSPECT') then round(f.corrected, 4) end corrected_value, t.trust, case when is_hard then 1.0 when is_soft then 0.5 else 0.0 end physics, round(f.confidence, 4) confidence, nullif(split_part(rule_ids, ',', 1), '') physics_rule, f.ml iforest, round(f.z, 6) spatial_z, round(coalesce(f.dev_sigma, 0), 6) dev_sigma, f.value as value
from imp f join trust t using (station_id, ts, variable)"""


def _detected(r: DataFrame) -> DataFrame:
    return _out(r, "variable", "status", "fault_type", "severity", _r("corrected_value", digits=4), "trust", F.col("scores.physics").alias("physics"), "confidence", F.col("scores.physics_rule").alias("physics_rule"), F.col("scores.iforest").alias("iforest"), F.round("scores.spatial_z", 6).alias("spatial_z"), F.round("scores.dev_sigma", 6).alias("dev_sigma"), "value")


@query(_DETECTED)
def q_detect(spark, d):
    return _detected(detect.verdicts(_signals(spark, d)))


@query(rf"select station_id, {TS}, variable, round(near_anomaly, 6) near_anomaly from nearby", chain=lambda select: OFF_GRID + select)
def q_interval_anomaly(spark, d):
    """What all neighbours' readings within two hours say, of readings at the times of their events."""
    raw = climatology.with_climatology(ingest.long_form(_raw(spark, d)), _clim(spark, d))
    return _out(spatial.interval_anomaly(raw, _edges(spark, d)), "variable", _r("near_anomaly"))


@query(_DETECTED.replace("round(f.corrected, 4)", "round(f.corrected + 1e-7, 4)"), chain=lambda select: OFF_GRID + select)
def q_detect_offgrid(spark, d):
    """The detector on readings at the times of their events; corrected values a hair higher, as many are halves of the last digit shown."""
    s = detect.signals(_raw(spark, d), _clim(spark, d), _edges(spark, d), ("event_id",), on_grid=False)
    return _detected(detect.verdicts(s.withColumn("ml_score", _stand_in())).withColumn("corrected_value", F.col("corrected_value") + 1e-7))


@query()
def q_detect_full(spark, d):
    """The whole detector with its own climatology, forest of 200 trees and calibration, fitted on the readings."""
    r = detect.detect(_readings(spark, d).drop("event_id"), _stations(spark, d))
    return _out(r, "variable", "value", "status", "fault_type", "confidence", "severity", F.array_join("reasons", " | ").alias("reasons"), "corrected_value", "trust", F.to_json("shap_top").alias("shap_top"), F.col("scores.iforest").alias("iforest"))


@query(rf"""select f.station_id, strftime(f.ts, '%Y-%m-%d %H:%M:%S') ts, f.variable, f.status, case when f.status <> 'NORMAL' then f.fault_type end fault_type, f.severity, case when f.status in ('SENSOR_FAULT', 'SUSPECT') then round(f.corrected, 4) end corrected_value, t.trust
from imp f join trust t using (station_id, ts, variable) where f.ts <= (select max(ts) from readings) - interval 2 hour""")
def q_stream_detect(spark, d):
    """The detector over a stream of three files, two of them out of order by weeks, with the stand-in score, up to the look-ahead; at the end all clocks tick on."""
    base = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    r = _readings(spark, d).withColumn("tick", F.lit(False))
    early, odd = F.col("ts") < F.lit("2024-01-18 05:00:00").cast("timestamp"), F.hour("ts") % 6 == 1
    last = r.agg(F.max("ts")).first()[0]
    ticks = r.select("station_id").distinct().select("station_id", (F.lit(last) + F.expr("interval 20 days")).alias("ts"), *[F.lit(None).cast(t).alias(c) for c, t in (("event_id", "long"), *((v, "double") for v in VARIABLES))], F.lit(True).alias("tick"))
    columns = ("station_id", "ts", "event_id", *VARIABLES, "tick")
    for part in (r.where(early & ~odd), r.where(early & odd), r.where(~early).select(*columns).unionByName(ticks)):
        part.select(*columns).coalesce(1).write.mode("append").parquet(f"{base}/in")
    schema = "station_id string, ts timestamp, event_id long, temp_c double, pressure_hpa double, rh_pct double, tick boolean"
    score = lambda signals: signals.withColumn("ml_score", _stand_in())
    out = detect_stream(spark, f"{base}/in", schema, _edges(spark, d), _clim(spark, d), score, f"{base}/run", {"event_id": "bigint"}, late_h=24 * 20)
    return _out(out.where(F.col("ts") <= F.lit(last) - F.expr("interval 2 hours")), "variable", "status", "fault_type", "severity", _r("corrected_value", digits=4), "trust")


#: Trust from the usual start over the rows of own.
_OWN_TRUST = """pd as (select station_id, variable, list(d order by ts) ds, list(ts order by ts) tss from (select station_id, variable, ts, case when status = 'SENSOR_FAULT' then -(case severity when 'MEDIUM' then 5 when 'HIGH' then 10 when 'CRITICAL' then 20 else 2 end)::double when status = 'NORMAL' then 0.5 else 0 end d from own) group by all),
pt as (select station_id, variable, unnest(tss) ts, unnest(list_transform(range(1, len(ds) + 1), lambda i: list_reduce(list_prepend(100.0::double, ds[1:i]), lambda a, x: least(greatest(a + x, 0), 100)))) trust from pd)"""


@query(", own as (select * from imp where ts > timestamp '2024-01-21 00:00:00' and ts <= timestamp '2024-01-22 00:00:00'), " + _OWN_TRUST + " " + _DETECTED.replace("from imp f join trust t", "from own f join pt t"))
def q_detect_at(spark, d):
    """The last day before a jump, from readings kept for long enough, with trust as for new sensors."""
    score = lambda readings: ingest.long_form(readings, ("event_id",)).select("station_id", "ts", "variable", _stand_in().alias("ml_score"))
    return _detected(detect.detect_at(_readings(spark, d), _edges(spark, d), _clim(spark, d), score, F.lit("2024-01-22 00:00:00").cast("timestamp"), keep_h=24 * 366))


@query(rf""", hrs as (select ts, row_number() over (order by ts) - 1 i from (select distinct ts from readings)), jp as (select min(i) p from hrs where ts >= timestamp '2024-01-15 00:00:00'),
span as (select min(ts) a, max(ts) b from hrs, jp where i between p - 24 and p + 40), own as (select d.* from dec d, span where ts between a and b),
{_OWN_TRUST}
select station_id, {TS}, variable, value as value, status, round(confidence, 4) confidence, severity, is_hard, trust from own join pt using (station_id, ts, variable), span where epoch(ts) > epoch(b) - 48 * 3600""")
def q_replay_cursor(spark, d):
    """A jump, then 1 and 39 hours on; of the results the last 48 hours stay."""
    score = lambda readings: ingest.long_form(readings, ("event_id",)).select("station_id", "ts", "variable", _stand_in().alias("ml_score"))
    c = Cursor(_readings(spark, d), _edges(spark, d), _clim(spark, d), score, keep_h=48)
    c.jump("2024-01-15 00:00:00")
    c.advance()
    c.advance(39)
    return _out(c.results, "variable", "value", "status", "confidence", "severity", (F.col("scores.physics") == 1.0).alias("is_hard"), "trust")


@query("select station_id, neighbour_id, round(km, 1) distance_km, row_number() over (partition by station_id order by km, neighbour_id) place from pairs where km <= 20")
def q_neighbours_ranked(spark, d):
    return geo.neighbours_ranked(_stations(spark, d, None), 20.0, digits=1).withColumn("place", F.col("place").cast("long"))


@query("select station_id, ['NORMAL', 'GENUINE_EVENT', 'SUSPECT', 'SENSOR_FAULT'][max(case status when 'NORMAL' then 1 when 'GENUINE_EVENT' then 2 when 'SUSPECT' then 3 else 4 end)] status, min(trust) trust from res, now where ts = t group by 1")
def q_station_status(spark, d):
    r = _results(spark, d)
    return summary.station_status(r, _now(r))


@query("select station_id, variable, fault_type, status, severity, confidence, peak.v as value, peak.c corrected, strftime(s, '%Y-%m-%d %H:%M:%S') as start, strftime(e, '%Y-%m-%d %H:%M:%S') as \"end\", trust_before, trust_after from fruns")
def q_fault_runs(spark, d):
    return summary.fault_runs(_results(spark, d)).select("station_id", "variable", "fault_type", "status", "severity", "confidence", "value", "corrected", _time("start"), _time("end"), "trust_before", "trust_after")


@query("select station_id, strftime(s, '%Y-%m-%d %H:%M:%S') as start, strftime(e, '%Y-%m-%d %H:%M:%S') as \"end\", confidence, parts, stations from wev")
def q_weather_events(spark, d):
    return summary.weather_events(_results(spark, d)).select("station_id", _time("start"), _time("end"), "confidence", "parts", "stations")


_ITEMS = ", items as (select 'fault' kind, station_id, variable, fault_type, status, confidence, s, e from fruns union all select 'weather', station_id, null, null, 'GENUINE_EVENT', confidence, s, e from wev)"


@query(_ITEMS + " select kind, status, count(*) n, round(sum(confidence), 6) confidence from items group by all")
def q_union_feed(spark, d):
    return summary.alerts(_results(spark, d)).groupBy("kind", "status").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 6).alias("confidence"))


@query(_ITEMS + """, a as (select *, e = t active from items, now), k as (select count(*) filter (active) n from a),
f as (select *, row_number() over (partition by active order by s desc, kind, station_id, variable nulls first, fault_type nulls first) rn from a)
select kind, station_id, variable, fault_type, status, active, strftime(s, '%Y-%m-%d %H:%M:%S') as start from f, k where active or rn <= greatest(30 - k.n, 0)""")
def q_alert_feed(spark, d):
    r = _results(spark, d)
    return summary.alert_feed(r, _now(r)).select("kind", "station_id", "variable", "fault_type", "status", "active", _time("start"))


_DAY = """, day as (select * from res, now where ts > t - interval 24 hour),
dfr as (select *, sum(fresh) over (partition by station_id, variable order by ts) run from (select *, case when coalesce(lag(coalesce(fault_type, '')) over w = coalesce(fault_type, '') and ts - lag(ts) over w = interval 1 hour, false) then 0 else 1 end fresh from day where status in ('SUSPECT', 'SENSOR_FAULT') window w as (partition by station_id, variable order by ts))),
druns as (select max(ts) e, bool_or(status = 'SENSOR_FAULT') fault from dfr group by station_id, variable, run),
dgh as (select distinct station_id, ts from day where status = 'GENUINE_EVENT'),
dsev as (select station_id, min(ts) s, max(ts) e from (select *, sum(fresh) over (partition by station_id order by ts) run from (select *, case when ts - lag(ts) over (partition by station_id order by ts) = interval 1 hour then 0 else 1 end fresh from dgh)) group by station_id, run),
dwev as (select case when s <= max(e) over (order by s, station_id rows between unbounded preceding and 1 preceding) + interval 1 hour then 0 else 1 end fresh from dsev)"""


@query(_DAY + """ select l.trust lowest_trust, l.station_id lowest_station, l.variable lowest_variable, (select count(*) from druns, now where fault and e = t) open_faults, (select count(*) from druns where fault) faults_24h, (select coalesce(sum(fresh), 0)::bigint from dwev) events_24h, 20.0::double step_ms, (select count(*) from fruns where status = 'SENSOR_FAULT') runs_all, (select count(*) from wev) events_all
from (select trust, station_id, variable from res, now where ts = t order by trust, station_id, variable limit 1) l""")
def q_kpis(spark, d):
    r = _results(spark, d)
    whole = summary.fault_counts(r, _now(r)).select(F.col("faults").alias("runs_all")).crossJoin(summary.event_count(r).withColumnRenamed("events", "events_all"))
    return summary.kpis(r, _now(r), (10.0, 30.0)).crossJoin(whole)


@query("select station_id, variable, trust from res, now where ts = t")
def q_trust_now(spark, d):
    r = _results(spark, d)
    return summary.trust_now(r, _now(r))


@query(rf"select station_id, {TS}, variable, status from res, now where ts > t - interval 168 hour and ts <= t")
def q_retained(spark, d):
    r = _results(spark, d)
    return _out(summary.retained(r, _now(r)), "variable", "status")


_EVIDENCE = "case when eid % 4 = 0 then 1.0 when eid % 4 = 1 then 0.5 else 0.0 end::double physics, ((eid * 7919 + vi * 613) % 1000) / 1000.0::double iforest, case when eid % 5 > 0 then (eid % 9 - 4)::double end spatial_z"


@query(rf"select station_id, {TS}, variable, physics < 0.5 physics_ok, abs(spatial_z) <= 3 neighbours_ok, iforest < 0.97 pattern_ok from (select *, {_EVIDENCE} from res)")
def q_evidence(spark, d):
    return _out(summary.evidence_flags(_results(spark, d)), "variable", "physics_ok", "neighbours_ok", "pattern_ok")


@query(rf""", ev as (select *, {_EVIDENCE} from res), fg as (select f.*, 'reason ' || f.variable || ' ' || (f.eid % 13) reason, {_EVIDENCE} from frun f)
select station_id, variable, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, p.reason reasons, p.f iforest, p.z spatial_z from (select *, arg_max(struct_pack(reason := reason, f := iforest, z := spatial_z), struct_pack(a := coalesce(abs(value - corrected_value), 0), b := case when abs(value - corrected_value) > 0 then -epoch(ts) else epoch(ts) end)) over (partition by station_id, variable, kind, run) p from fg) group by station_id, variable, kind, run, p""")
def q_run_evidence(spark, d):
    r = summary.fault_runs(_results(spark, d))
    return r.select("station_id", "variable", _time("start"), F.array_join("reasons", ",").alias("reasons"), F.col("scores.iforest").alias("iforest"), F.col("scores.spatial_z").alias("spatial_z"))


@query(rf""", ev as (select *, 'reason ' || variable || ' ' || (eid % 13) reason, {_EVIDENCE} from res where status = 'GENUINE_EVENT'),
pick as (select * from ev qualify row_number() over (partition by station_id, ts order by variable <> 'temp_c', variable) = 1),
told as (select v.station_id, v.s, v.e, a.reason, b.iforest, b.spatial_z from sev v join pick a on a.station_id = v.station_id and a.ts = v.s join pick b on b.station_id = v.station_id and b.ts = v.e)
select w.station_id, strftime(w.s, '%Y-%m-%d %H:%M:%S') as start, t.reason reasons, t.iforest, t.spatial_z from wev w join told t on t.station_id = w.station_id and t.s = w.s""")
def q_event_evidence(spark, d):
    w = summary.weather_events(_results(spark, d))
    return w.select("station_id", _time("start"), F.array_join("reasons", ",").alias("reasons"), F.col("scores.iforest").alias("iforest"), F.col("scores.spatial_z").alias("spatial_z"))


@query(rf""", near as (select n.ts, n.variable, quantile_cont(n.value, 0.5) median from edges e join lng n on n.station_id = e.neighbour_id join limits l on l.variable = n.variable where e.station_id = 'ST-3' and n.value between lo and hi group by all),
w as (select distinct ts, true weather from res where station_id = 'ST-3' and status = 'GENUINE_EVENT'),
own as (select ts, case when temp_c between -30 and 55 then temp_c end t, case when rh_pct between 0 and 102 then rh_pct end h from readings where station_id = 'ST-3'),
dw as (select ts, 243.12 * g / nullif(17.62 - g, 0) dewpoint from (select ts, ln(greatest(h, 0.001) / 100.0) + 17.62 * t / nullif(243.12 + t, 0) g from own)),
p as (select x.station_id, x.ts, x.variable, case when x.value between lo and hi then x.value end reported, case when x.variable = 'temp_c' then round(dw.dewpoint, 6) end dewpoint, r.status, r.fault_type, case when r.status in ('SUSPECT', 'SENSOR_FAULT') then r.corrected_value end corrected, coalesce(weather, false) weather, median
  from lng x join limits l on l.variable = x.variable cross join now join res r on r.station_id = x.station_id and r.ts = x.ts and r.variable = x.variable left join w on w.ts = x.ts left join near n on n.ts = x.ts and n.variable = x.variable left join dw on dw.ts = x.ts where x.station_id = 'ST-3' and x.ts > t - interval 48 hour)
select station_id, {TS}, variable, reported, dewpoint, status, fault_type, corrected, weather, median, case when status in ('SUSPECT', 'SENSOR_FAULT') then coalesce(reported, corrected) end mark from p""")
def q_station_panel(spark, d):
    r = _results(spark, d)
    p = summary.station_panel(_readings(spark, d).drop("event_id"), r, _edges(spark, d), "ST-3", _now(r))
    return _out(p, "variable", "reported", _r("dewpoint"), "status", "fault_type", "corrected", "weather", "median", "mark")


@query("""select r.station_id, r.variable, r.trust, l.fault_type last_fault from res r join now on r.ts = t left join (select station_id, variable, arg_max(fault_type, ts) fault_type from res where status = 'SENSOR_FAULT' and fault_type is not null group by all) l on l.station_id = r.station_id and l.variable = r.variable where r.trust < 50""")
def q_maintenance(spark, d):
    r = _results(spark, d)
    return summary.maintenance(r, _now(r))


@query("""select strftime(s, '%Y-%m-%d %H:%M') as start, strftime(e, '%Y-%m-%d %H:%M') as "end", cast((epoch(e) - epoch(s)) / 3600 + 1 as bigint) as hours, r.station_id || ' ' || coalesce(st.name, '') station, variable sensor, status, coalesce(fault_type, '') fault_type, coalesce(severity, '') severity, round(confidence, 2) confidence, peak.v reported, peak.c corrected from fruns r left join stations st on st.station_id = r.station_id and st.s_suppkey < 8
union all select strftime(s, '%Y-%m-%d %H:%M'), strftime(e, '%Y-%m-%d %H:%M'), cast((epoch(e) - epoch(s)) / 3600 + 1 as bigint), stations, '', 'GENUINE_EVENT', '', '', round(confidence, 2), null, null from wev""")
def q_alert_log(spark, d):
    return summary.alert_log(_results(spark, d), _stations(spark, d))


@query("""select s.station_id, v.variable, strftime(r.ts, '%Y-%m-%d %H:%M:%S') ts, r.status from stations s cross join limits v left join (select * from res, now where ts > t - interval 72 hour and ts <= t) r on r.station_id = s.station_id and r.variable = v.variable where s.s_suppkey < 8""")
def q_health_matrix(spark, d):
    r = _results(spark, d)
    return _out(summary.health_matrix(r, _stations(spark, d), _now(r)), "variable", "status")


@query("""select x.a, x.b, case when sa = 'SENSOR_FAULT' or sb = 'SENSOR_FAULT' then 'fault' when sa = 'GENUINE_EVENT' and sb = 'GENUINE_EVENT' then 'weather' else 'plain' end state from (select l.a, l.b, p.status sa, q.status sb from (select distinct least(station_id, neighbour_id) a, greatest(station_id, neighbour_id) b from (select * from edges qualify row_number() over (partition by station_id order by km, neighbour_id) <= 3)) l
left join (select station_id, ['NORMAL', 'GENUINE_EVENT', 'SUSPECT', 'SENSOR_FAULT'][max(case status when 'NORMAL' then 1 when 'GENUINE_EVENT' then 2 when 'SUSPECT' then 3 else 4 end)] status from res, now where ts = t group by 1) p on p.station_id = l.a
left join (select station_id, ['NORMAL', 'GENUINE_EVENT', 'SUSPECT', 'SENSOR_FAULT'][max(case status when 'NORMAL' then 1 when 'GENUINE_EVENT' then 2 when 'SUSPECT' then 3 else 4 end)] status from res, now where ts = t group by 1) q on q.station_id = l.b) x""")
def q_link_states(spark, d):
    r = _results(spark, d)
    return summary.link_states(r, geo.nearest_links(_stations(spark, d)), _now(r))


@query(rf"select station_id, {TS}, variable, label, event_name event_id, true_value, status from res where status <> 'NORMAL'")
def q_align(spark, d):
    r = _results(spark, d)
    wide = r.groupBy("station_id", "ts", "event_id").agg(*[F.max(F.when(F.col("variable") == v, F.col(c))).alias(f"{p}_{v}") for v in VARIABLES for p, c in (("label", "label"), ("orig", "true_value"))])
    return _out(evaluate.align(r.drop("label", "event_id", "true_value"), wide).where("status <> 'NORMAL'"), "variable", "label", "event_id", "true_value", "status")


@query("""select fault_type, tp, fp, fn, tp + fn events, round(pr, 4) as precision, round(rc, 4) recall, round(case when round(pr, 4) + round(rc, 4) > 0 then 2 * round(pr, 4) * round(rc, 4) / (round(pr, 4) + round(rc, 4)) else 0 end, 4) f1
from (select f.fault_type, coalesce(tp, 0) tp, coalesce(fp, 0) fp, coalesce(fn, 0) fn, case when coalesce(tp, 0) + coalesce(fp, 0) > 0 then tp / (tp + coalesce(fp, 0)) else 0 end pr, case when coalesce(tp, 0) + coalesce(fn, 0) > 0 then tp / (tp + fn) else 0 end rc
from (values ('SPIKE'), ('FROZEN'), ('DRIFT'), ('DROPOUT'), ('NOISE'), ('OUT_OF_RANGE')) f(fault_type)
left join (select label, count(*) filter (hit) tp, count(*) filter (not hit) fn from (select label, variable, event_name, bool_or(status in ('SUSPECT', 'SENSOR_FAULT')) hit from res where label <> 'NONE' group by all) group by 1) h on h.label = f.fault_type
left join (select fault_type, sum(fresh)::bigint fp from (select fault_type, case when ts - lag(ts) over (partition by station_id, variable, fault_type order by ts) = interval 1 hour then 0 else 1 end fresh from res where status in ('SUSPECT', 'SENSOR_FAULT') and label = 'NONE' and fault_type is not null) group by 1) p on p.fault_type = f.fault_type)""")
def q_scorecard(spark, d):
    return evaluate.fault_scores(_results(spark, d)).select("fault_type", "tp", "fp", "fn", "events", "precision", "recall", "f1")


@query("""select unnest(['False alarms during storms', 'False alarms, normal weather', 'Fault type named correctly', 'Mean check time']) as name, unnest([s, n, a, l]) as value, unnest([printf('%.1f%%', s * 100), printf('%.1f%%', n * 100), printf('%.1f%%', a * 100), printf('%.0f ms', l)]) as text
from (select round(count(*) filter (status = 'SENSOR_FAULT' and label = 'NONE' and storm) / greatest(count(*) filter (label = 'NONE' and storm), 1), 4) s, round(count(*) filter (status = 'SENSOR_FAULT' and label = 'NONE' and not storm) / greatest(count(*) filter (label = 'NONE' and not storm), 1), 4) n,
round(count(*) filter (flagged and label <> 'NONE' and fault_type = label) / nullif(count(*) filter (flagged and label <> 'NONE'), 0), 4) a, round(avg(eid % 40), 2) l from (select *, event_name like 'STORM%' storm, status in ('SUSPECT', 'SENSOR_FAULT') flagged from res))""")
def q_scorecard_tiles(spark, d):
    r = _results(spark, d)
    latency = evaluate.mean_latency(_long(spark, d).select((F.col("event_id") % 40).cast("string").alias("latency_ms")))
    return evaluate.scorecard_tiles(evaluate.overall_rates(r), latency)


@query("""select round(count(*) filter (status = 'SENSOR_FAULT' and label = 'NONE' and not storm) / greatest(count(*) filter (label = 'NONE' and not storm), 1), 3) far_normal, round(count(*) filter (status = 'SENSOR_FAULT' and label = 'NONE' and storm) / greatest(count(*) filter (label = 'NONE' and storm), 1), 3) far_storm,
round(count(*) filter (flagged and label <> 'NONE' and fault_type = label) / nullif(count(*) filter (flagged and label <> 'NONE'), 0), 3) accuracy from (select *, event_name like 'STORM%' storm, status in ('SUSPECT', 'SENSOR_FAULT') flagged from res)""")
def q_false_alarms(spark, d):
    o = evaluate.overall_rates(_results(spark, d))
    return o.select(_r("false_alarm_rate_normal", "far_normal", 3), _r("false_alarm_rate_storm", "far_storm", 3), _r("fault_type_accuracy", "accuracy", 3))


@query("select l.variable, round(avg(abs(corrected_value - true_value)), 3) mae from limits l left join (select * from res where status in ('SUSPECT', 'SENSOR_FAULT') and label <> 'NONE' and corrected_value is not null and true_value is not null) r on r.variable = l.variable group by 1")
def q_impute_mae(spark, d):
    return evaluate.impute_error(_results(spark, d)).select("variable", _r("mae", digits=3))


_SCORES = ", sc as (select *, ((eid * 7919 + vi * 613) % 1000) / 1000.0::double ml from res)"


_SWEPT = _SCORES + """, swept as (select high, suspect, sigma, count(*) filter (ml >= suspect and label <> 'NONE') tp, count(*) filter (ml < suspect and label <> 'NONE') fn, count(*) filter (ml >= suspect and label <> 'NONE') / count(*) filter (label <> 'NONE') r,
round(count(*) filter (ml >= suspect and label = 'SPIKE') / nullif(count(*) filter (label = 'SPIKE'), 0), 4) recall_spike, round(count(*) filter (ml >= suspect and label = 'FROZEN') / nullif(count(*) filter (label = 'FROZEN'), 0), 4) recall_frozen, round(count(*) filter (ml >= suspect and label = 'DRIFT') / nullif(count(*) filter (label = 'DRIFT'), 0), 4) recall_drift
from sc cross join (values (0.97::double), (0.98), (0.985), (0.99), (0.995)) h(high) cross join (values (0.9::double), (0.93), (0.95), (0.97)) s(suspect) cross join (values ('3.0,6.0,10.0'), ('2.5,5.0,8.0'), ('3.5,7.0,12.0')) g(sigma) where suspect < high group by all),
swept2 as (select high, suspect, sigma, tp, fn, 0 fp, round(case when tp > 0 then 1 else 0 end, 4)::double as precision, round(r, 4) recall, round(case when r > 0 then 2 * r / (1 + r) else 0 end, 4) f1, 0.0::double storm_far, 0.0::double normal_far, recall_spike, recall_frozen, recall_drift from swept)"""


def _swept(spark, d):
    r = _results(spark, d).join(_long(spark, d).select("station_id", "ts", "variable", F.col("event_id").alias("eid")), ["station_id", "ts", "variable"])
    r = r.withColumn("ml_score", F.col("scores.iforest")).withColumn("is_storm", F.col("event_id").startswith("STORM"))
    return evaluate.sweep(r)


def _sweep_columns(swept):
    kinds = [F.element_at("per_fault_recall", f).alias(f"recall_{f.lower()}") for f in ("SPIKE", "FROZEN", "DRIFT")]
    return swept.select("high", "suspect", F.array_join(F.col("sigma").cast("array<string>"), ",").alias("sigma"), "tp", "fn", F.col("fp").cast("int").alias("fp"), "precision", "recall", "f1", "storm_far", "normal_far", *kinds)


@query(_SWEPT + " select * from swept2")
def q_threshold_sweep(spark, d):
    return _sweep_columns(_swept(spark, d))


@query(_SWEPT + """ select * from swept2 order by f1 desc, storm_far, high, suspect, string_split(sigma, ',')::double[] limit 1""")
def q_best_thresholds(spark, d):
    return _sweep_columns(evaluate.best_pair(_swept(spark, d)))


@query(_SCORES + rf""", u as (select variable, ml, count(*) filter (eid % 3 = 0) c from sc group by all), v as (select *, sum(c) over (partition by variable order by ml) upto, sum(c) over (partition by variable) total from u)
select s.station_id, strftime(s.ts, '%Y-%m-%d %H:%M:%S') ts, s.variable, round(upto / total, 6) ml_score, round((upto - c) / total, 6) below from sc s join v on v.variable = s.variable and v.ml = s.ml""")
def q_percentile_rank(spark, d):
    """Every row among the calibration of a third of them, from both sides."""
    r = _long(spark, d).withColumn("raw", ((F.col("event_id") * 7919 + by_variable(dict(zip(VARIABLES, (0, 1, 2), strict=True))) * 613) % 1000) / 1000.0)
    cal = r.where("event_id % 3 = 0").select("variable", F.col("raw").alias("score"))
    return _out(trees.percentile_rank(r, cal, side="both"), "variable", _r("ml_score"), _r("below"))


_T0 = "2024-01-08 00:00:00"


def _quoted(rows: list[tuple]) -> str:
    one = lambda x: "null" if x is None else f"'{x}'" if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else f"{x!r}::double" if isinstance(x, float) else str(x)
    return ", ".join(f"({', '.join(map(one, r))})" for r in rows)


def _injection_sql(faults: list[tuple], storms: list[tuple] = ()) -> str:
    """The injected readings: storms (event_id, center, second, strength, onset, temp, rh, pressure), then faults (event_id, station, variable, fault, second, hours, magnitude, free)."""
    none = [("", "", 0, 0.0, 1, 0.0, 0.0, 0.0)]
    out = rf""", storm(event_name, center, second, strength, onset, temp_drop, rh_rise, pressure_rise) as (values {_quoted(storms or none)}),
reach as (select s.*, st.station_id, 2 * 6371.0 * asin(sqrt(pow(sin(radians(st.lat - c.lat) / 2), 2) + cos(radians(c.lat)) * cos(radians(st.lat)) * pow(sin(radians(st.lon - c.lon) / 2), 2))) km from storm s join stations c on c.station_id = s.center join stations st on st.s_suppkey < 8),
wave as (select station_id, to_timestamp(second + 3600 * (cast(round(km / 30) as bigint) + k))::timestamp ts, event_name, strength * case when k < onset then (k + 1) / onset else exp(-(k - onset) / 3) end sh, temp_drop, rh_rise, pressure_rise from (select *, unnest(range(0, onset + 6)) k from reach where km <= 80)),
fault(event_name, station_id, variable, fault, second, hours, magnitude, free) as (values {_quoted(faults)}),
b as (select r.station_id, r.ts, event_name storm, case when sh is not null then temp_c - temp_drop * sh else temp_c end temp_c, case when sh is not null then pressure_hpa + pressure_rise * sh else pressure_hpa end pressure_hpa, case when sh is not null then greatest(least(rh_pct + rh_rise * sh, 100), 0) else rh_pct end rh_pct from readings r left join wave w on w.station_id = r.station_id and w.ts = r.ts)"""
    for v, (lo, hi) in CONFIG["range"].items():
        jump = f"case when free then case when avg({v}) over e > 50 then -abs(magnitude) else abs(magnitude) end else magnitude end" if v == "rh_pct" else "magnitude"
        u = lambda a: f"(('0x' || substr(md5(key), {a}, 8))::bigint + 1) / 4294967298.0::double"
        value = f"""case fault when 'SPIKE' then {v} + {jump} when 'FROZEN' then first_value({v} ignore nulls) over e when 'DRIFT' then {v} + case when count(*) over e > 1 then magnitude * (row_number() over f - 1) / (count(*) over e - 1) else magnitude end
when 'NOISE' then {v} + magnitude * step * sqrt(-2 * ln({u(1)})) * cos(2 * pi() * {u(9)}) when 'DROPOUT' then magnitude when 'OUT_OF_RANGE' then magnitude else {v} end"""
        clipped = f"case when fault in ('SPIKE', 'DRIFT', 'NOISE') then greatest(least({value}, 100), 0) else {value} end" if v == "rh_pct" else value
        out += rf""",
s_{v} as (select station_id, stddev_samp(d) step from (select station_id, x - lag(x) over (partition by station_id order by ts) d from (select station_id, ts, case when {v} between {lo} and {hi} then {v} end x from b)) group by 1),
i_{v} as (select station_id, ts, fault, event_name, {clipped} x from (select b.*, f.*exclude (station_id), f.event_name || '|' || strftime(b.ts, '%Y-%m-%d %H:%M:%S') as key, step from b left join fault f on f.station_id = b.station_id and f.variable = '{v}' and epoch(b.ts) >= second and epoch(b.ts) < second + 3600 * hours left join s_{v} on s_{v}.station_id = b.station_id) y
  window e as (partition by station_id, event_name order by ts rows between unbounded preceding and unbounded following), f as (partition by station_id, event_name order by ts))"""
    shown = ", ".join(f"round(i_{v}.x, 6) {v}, coalesce(i_{v}.fault, 'NONE') label_{v}" for v in VARIABLES)
    return out + rf""" select b.station_id, strftime(b.ts, '%Y-%m-%d %H:%M:%S') ts, {shown}, coalesce({', '.join(f'i_{v}.event_name' for v in reversed(VARIABLES))}, storm, '') event_id from b {' '.join(f'join i_{v} on i_{v}.station_id = b.station_id and i_{v}.ts = b.ts' for v in VARIABLES)}"""


def _shown(out: DataFrame) -> DataFrame:
    return _out(out, *map(_r, VARIABLES), *[f"label_{v}" for v in VARIABLES], "event_id")


def _seconds(rows: list[tuple], kinds: str, spark) -> DataFrame:
    return spark.createDataFrame(rows, kinds.replace("start timestamp", "at long")).withColumn("start", F.timestamp_seconds("at")).drop("at")


_AT = 1704672000


def _injected(fault: str, hours: int, magnitude: float | None, variable: str = "temp_c", free: bool = False):
    rows = [("E_001", "ST-4", variable, fault, _AT, hours, magnitude, free)]

    def run(spark, d):
        return _shown(inject.inject_faults(inject.add_labels(_readings(spark, d).drop("event_id")), _seconds(rows, inject.EVENTS + ", free_sign boolean", spark)))

    run.__name__ = f"q_inject_{fault.lower()}" + ("_rh" if variable == "rh_pct" else "")
    query(_injection_sql(rows))(run)


for _fault in (("SPIKE", 2, 12.5), ("SPIKE", 2, 30.0, "rh_pct", True), ("FROZEN", 20, 0.0), ("DRIFT", 73, 4.0), ("DROPOUT", 8, None), ("OUT_OF_RANGE", 10, 60.0), ("NOISE", 24, 3.0), ("NOISE", 24, 3.0, "rh_pct")):
    _injected(*_fault)


@query(_injection_sql([("", "", "", "", 0, 0, 0.0, False)], [("STORM_001", "ST-1", _AT, 1.0, 2, 7.0, 25.0, 2.5)]))
def q_inject_storm(spark, d):
    return _shown(inject.inject_storm(inject.add_labels(_readings(spark, d).drop("event_id")), _stations(spark, d), "ST-1", _T0))


#: The network of the tables as the plan of a test set takes it, and a plan for a month of it.
_PLACES = [(f"ST-{k + 1}", 28 + (k * 37 % 64) / 128, 77 + (k * 11 % 64) / 128) for k in range(8)]
_FRONTS, _FAULTS = inject.plan_test_set(_PLACES, 1704067200, 720, per_fault=4, storms=3)


@query(_injection_sql(_FAULTS, _FRONTS))
def q_build_test_set(spark, d):
    """Three storms and four faults of each kind, as far as they find room."""
    out = inject.inject_storms(inject.add_labels(_readings(spark, d).drop("event_id")), _stations(spark, d), _seconds(_FRONTS, inject.STORMS, spark))
    return _shown(inject.inject_faults(out, _seconds(_FAULTS, inject.EVENTS + ", free_sign boolean", spark)))


_NEXT = _AT + 3600
_FAULTED = _injection_sql([("OUT_OF_RANGE_001", "ST-4", "temp_c", "OUT_OF_RANGE", _NEXT, 1, 55.0, False), ("FROZEN_001", "ST-2", "rh_pct", "FROZEN", _NEXT, 12, 0.0, False)], [("STORM_001", "ST-1", _NEXT, 1.2, 2, 7.0, 25.0, 2.5)])


@query(_FAULTED.replace(" select b.station_id, strftime", ", laid as (select b.station_id, strftime", 1) + """)
select 'applied' step, station_id, ts, temp_c, pressure_hpa, rh_pct, replace(label_temp_c, 'OUT_OF_RANGE', 'SPIKE') label_temp_c, label_rh_pct, replace(event_id, 'OUT_OF_RANGE', 'SPIKE') event_id from laid
union all select 'refused', 'ST-1', null, null, null, null, null, null, null union all select 'refused', 'ST-none', null, null, null, null, null, null, null
union all select 'cleared', station_id, strftime(ts, '%Y-%m-%d %H:%M:%S'), round(temp_c, 6), round(pressure_hpa, 6), round(rh_pct, 6), 'NONE', 'NONE', '' from readings""")
def q_replay_injections(spark, d):
    """A storm, a spike and a freeze from the next hour on; a second storm and a spike without a reading are refused; then all is cleared."""
    lay = overlay.Overlay(_readings(spark, d).drop("event_id"), _stations(spark, d))
    lay.inject_storm(_T0, "ST-1")
    refused = ["ST-1"] if lay.inject_storm("2024-01-08 04:00:00", "ST-1") is None else []
    lay.inject_spike(_T0, "ST-4")
    lay.inject_freeze(_T0, "ST-2")
    refused += ["ST-none"] if lay.inject_spike(_T0, "ST-none") is None else []
    shown = lambda step: _shown(lay.readings()).select(F.lit(step).alias("step"), "station_id", "ts", *VARIABLES, "label_temp_c", "label_rh_pct", "event_id")
    applied = shown("applied")
    none = spark.createDataFrame([("refused", s, *([None] * 7)) for s in refused], applied.schema)
    lay.clear()
    return applied.unionByName(none).unionByName(shown("cleared"))


_PREVIEW = [("E_001", "ST-4", "temp_c", "SPIKE", _AT, 2, 12.5, False), ("E_002", "ST-2", "pressure_hpa", "FROZEN", _AT, 30, 0.0, False), ("E_003", "ST-5", "rh_pct", "DROPOUT", _AT, 8, None, False), ("E_004", "ST-7", "temp_c", "DRIFT", _AT, 40, 3.0, False)]


_PREVIEW_SQL = """, truth as (select station_id, ts, 'temp_c' variable, label_temp_c label, event_name, was_temp_c true_value from laid union all select station_id, ts, 'pressure_hpa', label_pressure_hpa, event_name, was_pressure_hpa from laid union all select station_id, ts, 'rh_pct', label_rh_pct, event_name, was_rh_pct from laid),
nm as (select station_id, ts, variable, med, list_median(list_transform(vs, lambda x: abs(x - med))) mad from (select *, list_median(vs) med from (select e.station_id, n.ts, n.variable, list(n.value) vs from edges e join lng n on n.station_id = e.neighbour_id join limits l on l.variable = n.variable where n.value between lo and hi group by all) where len(vs) >= 2)),
px as (select p.*, t.label, t.true_value, coalesce(t.event_name like 'STORM%', false) storm, m.med, (p.value - m.med) / (1.4826 * m.mad + p.mad_floor) z from phys p join truth t using (station_id, ts, variable) left join nm m using (station_id, ts, variable)),
pv as (select *, label <> 'NONE' faulty, is_hard or is_soft or coalesce(abs(z) > 3, false) backed from px),
ps as (select *, case when faulty and backed then 'SENSOR_FAULT' when faulty then 'SUSPECT' when storm then 'GENUINE_EVENT' else 'NORMAL' end status,
  case when faulty and backed then case label when 'SPIKE' then 'CRITICAL' when 'OUT_OF_RANGE' then 'CRITICAL' when 'DROPOUT' then 'HIGH' when 'FROZEN' then 'HIGH' else 'MEDIUM' end when faulty then 'MEDIUM' end severity,
  case when faulty or storm then list_filter([case when missing then variable || ' is missing or a dropout value' end, case when abs(value - lag1) > 0 then variable || ' changed by ' || printf('%.2f', round(value - lag1, 2)) || ' since the last reading' end, case when flatline then variable || ' has stayed at ' || printf('%.2f', round(value, 2)) end, case when med is not null and not missing then printf('%.2f', round(value - med, 2)) || ' away from the neighbours'' median' end], lambda x: x is not null) else [] end facts from pv),
pd as (select station_id, variable, list(d order by ts) ds, list(ts order by ts) tss from (select station_id, variable, ts, case when status = 'SENSOR_FAULT' then -(case severity when 'MEDIUM' then 5 when 'HIGH' then 10 else 20 end)::double when status = 'NORMAL' then 0.5 else 0 end d from ps) group by all),
pt as (select station_id, variable, unnest(tss) ts, unnest(list_transform(range(1, len(ds) + 1), lambda i: list_reduce(list_prepend(100.0::double, ds[1:i]), lambda a, x: least(greatest(a + x, 0), 100)))) trust from pd)
select station_id, strftime(ts, '%Y-%m-%d %H:%M:%S') ts, variable, round(value, 6) as value, status, case when faulty then label end fault_type, case when faulty and backed then 0.9 when faulty then 0.5 when storm then 0.85 else 0.0 end::double confidence, severity, case when faulty then true_value end corrected_value, array_to_string(facts, ' | ') reasons,
  case when faulty or storm then case when is_hard then 1.0 when is_soft then 0.5 else 0.0 end::double end physics, case when faulty or storm then round(z, 6) end spatial_z, trust from ps join pt using (station_id, ts, variable)"""
_PREVIEW_STORM = [("STORM_001", "ST-1", _AT + 86400, 1.0, 2, 7.0, 25.0, 2.5)]


@query(over_injected(_injection_sql(_PREVIEW, _PREVIEW_STORM), _PREVIEW_SQL), chain=lambda select: select)
def q_preview(spark, d):
    """The preview over four faults and a storm, all of its columns."""
    stormy = inject.inject_storms(inject.add_labels(_readings(spark, d).drop("event_id")), _stations(spark, d), _seconds(_PREVIEW_STORM, inject.STORMS, spark))
    labelled = inject.inject_faults(stormy, _seconds(_PREVIEW, inject.EVENTS + ", free_sign boolean", spark))
    p = detect.preview(labelled, _edges(spark, d))
    return _out(p, "variable", _r("value"), "status", "fault_type", "confidence", "severity", "corrected_value", F.array_join("reasons", " | ").alias("reasons"), F.col("scores.physics").alias("physics"), F.round("scores.spatial_z", 6).alias("spatial_z"), "trust")


def _forest_sql(trees: int, subsample: int, seed: int) -> str:
    """The forest grown and asked level by level: rows of each tree's sample by node, and all rows by the node they stand at."""
    x = [f"x{k}" for k in range(len(FEATURES))]
    hexed = lambda a: f"('0x' || substr(md5({seed} || '|' || variable || '|' || tree || '|' || node), {a}, 8))::bigint / 4294967296.0::double"
    picked = lambda f: f"case {f} {' '.join(f'when {k} then {c}' for k, c in enumerate(x))} end"
    usual = lambda n: f"case when {n} > 2 then 2 * (ln({n} - 1) + 0.5772156649015329) - 2 * ({n} - 1)::double / {n} when {n} = 2 then 1 else 0 end"
    out = rf""", fx as (select row_number() over () rid, station_id, ts, variable, {seed} || '|' || station_id || '|' || ts || '.000000|' || variable as key, count(*) over (partition by variable) n, {", ".join(f"round({f}, 6)::double {c}" for f, c in zip(FEATURES, x, strict=True))} from ff),
pool as (select * from fx where n <= {2 * trees * subsample} or substr(md5(key), 1, 8) < printf('%08x', cast(floor({2.0 * trees * subsample} / n * 4294967296.0) as bigint))),
hashed as (select rid, variable, station_id, ts, b, md5(key || '|' || b) h from pool, (select unnest(range({-(-trees // 4)})) b)),
s0 as (select variable, tree, 1 node, {", ".join(x)} from (select rid, 4 * b + k tree from (select *, substr(h, 8 * k + 1, 8) d from hashed, (select unnest(range(4)) k)) where 4 * b + k < {trees} qualify row_number() over (partition by variable, b, k order by d, station_id, ts) <= {subsample}) join fx using (rid)),
a0 as (select rid, variable, tree, 1 node from fx, (select unnest(range({trees})) tree))"""
    levels = (subsample - 1).bit_length()
    for d in range(levels + 1):
        lows, highs = (", ".join(f"{f}({c})" for c in x) for f in ("min", "max"))
        out += rf""",
n{d} as materialized (select *, {hexed(1)} u, {hexed(9)} w, list_filter(range({len(x)}), lambda k: hi[1 + k] > lo[1 + k]) free from (select variable, tree, node, count(*) size, [{lows}] lo, [{highs}] hi from s{d} group by all)),
c{d} as materialized (select variable, tree, node, size, case when size > 1 and len(free) > 0 {"and false" if d == levels else ""} then free[1 + floor(u * len(free))::int] end f, w, lo, hi from n{d}),
k{d} as materialized (select variable, tree, node, size, f, lo[1 + f] + w * (hi[1 + f] - lo[1 + f]) cut, {d} + {usual("size")} len from c{d})"""
        if d < levels:
            out += rf""",
s{d + 1} as materialized (select s.variable, s.tree, 2 * node + case when {picked("f")} < cut then 0 else 1 end node, {", ".join(x)} from s{d} s join k{d} using (variable, tree, node) where f is not null),
a{d + 1} as materialized (select a.rid, a.variable, a.tree, 2 * node + case when {picked("f")} < cut then 0 else 1 end node from a{d} a join k{d} using (variable, tree, node) join fx using (rid) where f is not null)"""
    ends = " union all ".join(f"select rid, len from a{d} join k{d} using (variable, tree, node) where f is null" for d in range(levels + 1))
    return out + rf""", raws as (select rid, variable, pow(2, -sum(len) / any_value(usual)) raw from ({ends}) join fx using (rid) join (select variable, sum({usual("size")}) usual from k0 group by 1) using (variable) group by 1, 2),
ranked as (select *, count(*) over (partition by variable order by round(raw, 5))::double / count(*) over (partition by variable) ml_score from raws)
select f.station_id, f.ts, f.variable, round(raw, 6) raw, round(ml_score, 6) ml_score from ranked join fx f using (rid)"""


@query(_FEATURES_SQL + _forest_sql(CONFIG["trees"], CONFIG["subsample"], CONFIG["seed"]))
def q_iforest_score(spark, d):
    f = feats.feature_frame(_readings(spark, d), _clim(spark, d))
    forest = trees.Forest(trees.fit_forest(f))
    return _out(trees.score_forest(f, forest, trees.calibrate(f, forest)), "variable", _r("raw"), _r("ml_score"))


@query()
def q_contributions(spark, d):
    """Shapley values of the features of all readings that are not normal, by size."""
    f = feats.feature_frame(_readings(spark, d), _clim(spark, d))
    forest = trees.Forest(trees.fit_forest(f))
    scored = trees.score_forest(f, forest).join(fusion.decide(_signals(spark, d)).select("station_id", "ts", "variable", "status"), ["station_id", "ts", "variable"])
    x = trees.contributions(scored.where("status <> 'NORMAL'"), forest, len(FEATURES))
    return _out(x.select("*", F.posexplode("shap_top").alias("place", "part")), "variable", "status", "place", F.col("part.label").alias("label"), F.col("part.contribution").alias("contribution"))


_REASONS = """[case when missing then variable || ' is missing or a dropout value' end, case when out_of_range then variable || '=' || printf('%.2f', round(value, 2)) || ' is outside the physical range' end,
case when roc_soft or roc_hard then variable || ' changed by ' || printf('%.2f', round(abs(value - lag1), 2)) || ' since the last reading' end, case when dewpoint_max then 'The implied dewpoint of ' || printf('%.1f', round(dewpoint, 1)) || ' °C is more than air can hold' end,
case when dewpoint_jump then 'The implied dewpoint changed by ' || printf('%.1f', round(abs(dewpoint - prev_dewpoint), 1)) || ' °C' end, case when flatline then variable || ' has stayed at ' || printf('%.2f', round(value, 2)) end,
case when apart then 'Temperature jumped by ' || printf('%.1f', round(abs(value - lag1), 1)) || ' °C alone' end, case when n > 0 then n::bigint || ' neighbouring stations ' || case when consistent then 'agree' else 'disagree' end || ' (z = ' || printf('%.1f', round(coalesce(z, 0), 1)) || ')' end]"""


@query(rf"select station_id, {TS}, variable, status, case when len(rs) > 0 then array_to_string(rs[1:4], ' | ') when ml >= 0.95 then 'The pattern is very unusual for this sensor' else 'No single strong signal' end reasons from (select *, list_filter({_REASONS}, lambda x: x is not null) rs from dec where status <> 'NORMAL')")
def q_explain(spark, d):
    x = fusion.explain(fusion.decide(_signals(spark, d))).where("status <> 'NORMAL'")
    return _out(x, "variable", "status", F.array_join("reasons", " | ").alias("reasons"))


@query(rf""", rf as (select station_id, variable, list(d order by ts) ds, list(ts order by ts) tss from (select station_id, variable, ts, case when status = 'SENSOR_FAULT' then -(case severity when 'MEDIUM' then 5 when 'HIGH' then 10 when 'CRITICAL' then 20 else 2 end)::double when status = 'NORMAL' then 0.5 else 0 end d from res) group by all),
rp as (select station_id, variable, unnest(tss) ts, unnest(list_transform(range(1, len(ds) + 1), lambda i: list_reduce(list_prepend(100.0::double, ds[1:i]), lambda a, x: least(greatest(a + x, 0), 100)))) trust from rf) select station_id, {TS}, variable, trust from rp""")
def q_stream_replay(spark, d):
    """Trust by keyed state over a stream of the fixed results, one file at a time."""
    base = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    _results(spark, d).select("station_id", "variable", "ts", "status", "severity").write.parquet(f"{base}/in")
    out = replay(spark, f"{base}/in", "station_id string, variable string, ts timestamp, status string, severity string", f"{base}/check", f"{base}/out")
    return _out(out, "variable", "trust")


def flagship(spark, d):
    """Stations by severity of their deviation from the climatology."""
    return q_severity(spark, d)


