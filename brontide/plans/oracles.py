"""SQL for the catalogue: one chain of common tables over the driver's tables, and a last select per query."""

from __future__ import annotations

import re

CHAIN = r"""
with r0 as (select 'ST-' || (user_id % 8 + 1) station_id, date_trunc('hour', ts) hts, event_id, ts raw_ts, hour(ts) h, cast(round(value * 100) as bigint) cents from events),
r1 as (select *, abs(h - 14) o, day(hts) * 24 + hour(hts) hk from r0 qualify row_number() over (partition by station_id, hts order by raw_ts, event_id) = 1),
r2 as (select *, case when event_id % 97 = 0 then -9999.0 when event_id % 89 = 0 then null else 34 - 0.75 * o + (cents % 128) / 64 end t0 from r1),
readings as (select station_id, hts ts, event_id, hk,
  cast(case when station_id = 'ST-2' and hts between timestamp '2024-01-15 00:00:00' and timestamp '2024-01-16 23:00:00' then 20 + (hk - 360) * 0.25
    when hts between timestamp '2024-01-20 06:00:00' and timestamp '2024-01-20 10:00:00' then t0 - 8 else t0 end as double) temp_c,
  cast(case when station_id = 'ST-3' and hts between timestamp '2024-01-10 00:00:00' and timestamp '2024-01-11 12:00:00' then 1001.0 when event_id % 83 = 0 then 0.0 else 1000 + (cents % 64) / 32 end as double) pressure_hpa,
  cast(case when station_id = 'ST-5' and hts between timestamp '2024-01-12 00:00:00' and timestamp '2024-01-12 20:00:00' then 99.0 when station_id = 'ST-6' and hts between timestamp '2024-01-13 00:00:00' and timestamp '2024-01-13 20:00:00' then 55.0
    when event_id % 79 = 0 then 107.0 else 40 + 2 * o + (cents % 256) / 32 end as double) rh_pct from r2),
stations as (select 'ST-' || (s_suppkey + 1) station_id, s_name as name, 28 + (s_suppkey * 37 % 64) / 128 lat, 77 + (s_suppkey * 11 % 64) / 128 lon, s_suppkey from supplier),
limits(variable, vi, lo, hi, soft, hard, steps, mad_floor, std_floor, drift) as (values ('temp_c', 0, -30.0::double, 55.0::double, 6.0::double, 10.0::double, 6, 0.5::double, 0.3::double, 1.0::double), ('pressure_hpa', 1, 870.0, 1085.0, 3.0, 6.0, 12, 0.5, 0.5, 1.0), ('rh_pct', 2, 0.0, 102.0, 40.0, null, 6, 3.0, 2.0, 5.0)),
dew as (select *, ln(greatest(rh_pct, 0.001) / 100.0) + 17.62 * temp_c / nullif(243.12 + temp_c, 0) g from readings),
wide as (select * exclude (g), 243.12 * g / nullif(17.62 - g, 0) dewpoint from dew),
sib as (select *, lag(dewpoint) over w prev_dewpoint, lag(ts) over w prev_ts,
  coalesce(abs(temp_c - lag(temp_c) over w) > 6 and abs(pressure_hpa - lag(pressure_hpa) over w) <= 0.5 and abs(rh_pct - lag(rh_pct) over w) <= 3, false) decoupled from wide window w as (partition by station_id order by ts)),
lng as (select station_id, ts, event_id, hk, 'temp_c' variable, temp_c as value, dewpoint, prev_dewpoint, prev_ts, decoupled from sib
  union all select station_id, ts, event_id, hk, 'pressure_hpa', pressure_hpa, dewpoint, prev_dewpoint, prev_ts, decoupled from sib
  union all select station_id, ts, event_id, hk, 'rh_pct', rh_pct, dewpoint, prev_dewpoint, prev_ts, decoupled from sib),
clim as (select station_id, month(ts) m, hour(ts) hr, variable, avg(value) mean, greatest(coalesce(stddev_samp(value), max(std_floor)), max(std_floor)) std from lng join limits using (variable) group by all),
anom as (select lng.*, mean, std, value - mean anomaly, (value - mean) / std dev_sigma from lng left join clim on clim.station_id = lng.station_id and m = month(ts) and hr = hour(ts) and clim.variable = lng.variable),
hist as (select anom.*, lo, hi, soft, hard, steps, vi, mad_floor, drift, lag(value, 1) over w lag1, lag(value, 2) over w lag2, lag(value, 3) over w lag3, row_number() over w seen,
  case when variable = 'pressure_hpa' then count(*) over w12 = 12 and count(value) over w12 = 12 and min(value) over w12 = max(value) over w12
    else count(*) over w6 = 6 and count(value) over w6 = 6 and min(value) over w6 = max(value) over w6 end still
  from anom join limits using (variable) window w as (partition by station_id, variable order by ts), w6 as (partition by station_id, variable order by ts rows 5 preceding), w12 as (partition by station_id, variable order by ts rows 11 preceding)),
flg0 as (select *, coalesce(still and not (variable = 'rh_pct' and value >= 98), false) flat, (value is null or value in (-9999, -999) or (variable = 'pressure_hpa' and value = 0)) missing,
  abs(value - lag1) / greatest((epoch(ts) - epoch(prev_ts)) / 3600.0, 1e-9) rate from hist),
flg as (select *, not missing and coalesce(value < lo or value > hi, false) out_of_range, not missing and coalesce(rate > soft, false) roc_soft, not missing and coalesce(rate > hard, false) roc_hard,
  not missing and coalesce(dewpoint > 35, false) dewpoint_max, not missing and coalesce(abs(dewpoint - prev_dewpoint) > 8, false) dewpoint_jump, not missing and flat flatline, not missing and decoupled and variable = 'temp_c' apart from flg0),
phys as (select *, missing or out_of_range or roc_hard or dewpoint_max or flatline is_hard, roc_soft or dewpoint_jump or apart is_soft,
  concat_ws(',', case when missing then 'MISSING' end, case when out_of_range then 'RANGE' end, case when roc_soft or roc_hard then 'ROC' end, case when dewpoint_max then 'DEWPOINT_MAX' end, case when dewpoint_jump then 'DEWPOINT_JUMP' end, case when flatline then 'FLATLINE' end, case when apart then 'DECOUPLED' end) rule_ids,
  case when missing then 'DROPOUT' when flatline then 'FROZEN' when out_of_range then 'OUT_OF_RANGE' end fault_hint from flg),
pairs as (select a.station_id, b.station_id neighbour_id, 2 * 6371.0 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))) km from stations a join stations b on a.station_id <> b.station_id),
edges as (select p.* from pairs p join stations a on a.station_id = p.station_id join stations b on b.station_id = neighbour_id where km <= 150 and a.s_suppkey < 8 and b.s_suppkey < 8),
nb as (select e.station_id, n.ts, n.variable, list(n.anomaly) all_a, list(n.anomaly) filter (n.value between lo and hi) good from edges e join anom n on n.station_id = e.neighbour_id join limits l on l.variable = n.variable where n.anomaly is not null group by all),
nstat as (select *, list_median(all_a) med, list_median(list_transform(all_a, lambda x: abs(x - list_median(all_a)))) mad, len(all_a) n from nb where len(all_a) >= 2),
offs as (select h.station_id, h.ts, h.variable, k as off, n, (h.anomaly - med) / (1.4826 * mad + mad_floor) z from anom h cross join (select unnest(range(-2, 3)) k) o join nstat s on s.station_id = h.station_id and s.variable = h.variable and s.ts = h.ts + to_hours(k) join limits l on l.variable = h.variable),
spat as (select station_id, ts, variable, z, n, off, coalesce(abs(z) <= 3, false) consistent from offs qualify row_number() over (partition by station_id, ts, variable order by abs(z) nulls last, off) = 1),
nearby as (select h.station_id, h.ts, h.variable, list_median(flatten(list(good))) near_anomaly from anom h cross join (select unnest(range(-2, 3)) k) o join nb s on s.station_id = h.station_id and s.variable = h.variable and s.ts = h.ts + to_hours(k) group by all),
pat as (select phys.*, case when count(value) over s6 = 6 then stddev_samp(value) over s6 end std6, case when count(value) over s6 >= 4 then stddev_samp(value) over s6 end loose6,
  case when count(value) over s6 = 6 then sqrt(greatest(regr_syy(value, seen) over s6 - pow(regr_sxy(value, seen) over s6, 2) / regr_sxx(value, seen) over s6, 0) / 5) end residual6,
  case when count(value) over b >= 3 then quantile_cont(value, 0.5) over b end baseline, stddev_samp(value) over (partition by station_id, variable order by ts) all_std,
  count(value) over d24 = 24 full_day, max(abs(value - lag1)) over (partition by station_id, variable order by ts rows 22 preceding) max_step, abs(value - lag(value, 23) over (partition by station_id, variable order by ts)) net_day
  from phys window s6 as (partition by station_id, variable order by ts rows 5 preceding), d24 as (partition by station_id, variable order by ts rows 23 preceding), b as (partition by station_id, variable order by ts rows between 26 preceding and 3 preceding)),
pat2 as (select *, case when seen <= 12 then all_std else quantile_cont(loose6, 0.5) over (partition by station_id, variable order by ts rows between unbounded preceding and 6 preceding) end usual from pat),
sig as (select p.*, s.z, coalesce(s.n, 0) n, s.off, s.consistent, near_anomaly, ((event_id * 7919 + vi * 613) % 1000) / 1000.0::double ml from pat2 p left join spat s using (station_id, ts, variable) left join nearby using (station_id, ts, variable)),
dec0 as (select *, least(abs(coalesce(z, 0)) / 6, 1.0::double) zs, coalesce(not consistent, false) against, coalesce(consistent, false) agree,
  case when abs(coalesce(dev_sigma, 0)) >= 10 then 'CRITICAL' when abs(coalesce(dev_sigma, 0)) >= 6 then 'HIGH' when abs(coalesce(dev_sigma, 0)) >= 3 then 'MEDIUM' else 'LOW' end grade from sig),
dec as (select *, case when is_hard then 'SENSOR_FAULT' when ml >= 0.97 and (against or is_soft) then 'SENSOR_FAULT' when ml >= 0.97 and agree then 'GENUINE_EVENT' when ml >= 0.97 then 'SUSPECT' when ml >= 0.9 and against then 'SUSPECT' else 'NORMAL' end status,
  case when is_hard then 0.95 + 0.04 * ml when ml >= 0.97 and (against or is_soft) then 0.6 + 0.4 * (ml + zs) / 2 when ml >= 0.97 and agree then 0.7 + 0.3 * ml when ml >= 0.97 then least(0.6, 0.3 + 0.3 * ml) when ml >= 0.9 and against then 0.3 + 0.2 * (ml - 0.9) / (0.97 - 0.9) else 0 end confidence,
  case when is_hard then 'CRITICAL' when ml >= 0.97 or (ml >= 0.9 and against) then grade end severity from dec0),
fing as (select *, case when fault_hint is not null then fault_hint when missing then 'DROPOUT' when value < lo or value > hi then 'OUT_OF_RANGE' when flat then 'FROZEN'
  when (abs(lag1 - lag2) >= soft and abs(value - lag2) < soft) or (abs(lag2 - lag3) >= soft and abs(value - lag3) < soft and lag1 is not null) or abs(value - lag1) >= soft then 'SPIKE'
  when residual6 > 3 * greatest(usual, 1e-6) and usual is not null and std6 > 3 * greatest(usual, 1e-6) then 'NOISE'
  when abs(z) > 3 and full_day and max_step < soft and net_day > drift then 'DRIFT' when seen >= 2 and abs(value - baseline) >= 1.5 * soft then 'SPIKE' end fault_type from dec),
ok as (select *, case when value between lo and hi then value end okv from fing),
ext0 as (select *, last_value(okv ignore nulls) over (partition by station_id, variable order by ts rows between unbounded preceding and 1 preceding) p from ok),
ext as (select *, last_value(case when okv is not null then struct_pack(v := okv, q := p) end ignore nulls) over (partition by station_id, variable order by ts rows between unbounded preceding and 1 preceding) l from ext0),
imp as (select * exclude (l), coalesce(2 * l.v - l.q, l.v) temporal, coalesce((0.7 * (mean + near_anomaly) + 0.3 * coalesce(2 * l.v - l.q, l.v)) / 1.0, mean + near_anomaly, coalesce(2 * l.v - l.q, l.v), mean) corrected from ext),
delta as (select station_id, variable, ts, case when status = 'SENSOR_FAULT' then -(case severity when 'MEDIUM' then 5 when 'HIGH' then 10 when 'CRITICAL' then 20 else 2 end)::double when status = 'NORMAL' then 0.5 else 0 end d from dec),
folds as (select station_id, variable, list(d order by ts) ds, list(ts order by ts) tss from delta group by all),
prefix as (select station_id, variable, tss, list_transform(range(1, len(ds) + 1), lambda i: list_reduce(list_prepend(100.0::double, ds[1:i]), lambda a, x: least(greatest(a + x, 0), 100))) trusts from folds),
trust as (select station_id, variable, unnest(tss) ts, unnest(trusts) trust from prefix),
res as (select station_id, ts, variable, value, vi, event_id eid, hk, case when (hk // 5 + 3 * cast(substr(station_id, 4) as int) + vi) % 11 = 0 then 'SENSOR_FAULT' when (hk // 5 + 3 * cast(substr(station_id, 4) as int) + vi) % 11 = 1 then 'SUSPECT' when (hk // 7) % 9 = 2 and vi < 2 then 'GENUINE_EVENT' else 'NORMAL' end status,
  case (hk // 5) % 3 when 0 then 'SPIKE' when 1 then 'FROZEN' end fault_type, case event_id % 4 when 0 then 'LOW' when 1 then 'MEDIUM' when 2 then 'HIGH' else 'CRITICAL' end severity,
  (event_id % 50) / 64 confidence, value + (event_id % 7) / 8 corrected_value, ((event_id * 13 + vi * 29) % 101)::double trust,
  case when event_id % 10 < 3 then case (hk // 5) % 3 when 0 then 'SPIKE' when 1 then 'FROZEN' else 'DRIFT' end else 'NONE' end label, case when (hk // 7) % 9 = 2 then 'STORM_001' when event_id % 10 < 3 then 'F_' || (hk // 5) else '' end event_name, value - 0.25 true_value from lng join limits using (variable)),
now as (select max(ts) t from res),
frun as (select *, coalesce(fault_type, '') kind, from_run + 0 run from (select *, sum(fresh) over (partition by station_id, variable order by ts) from_run from (select *, case when coalesce(lag(coalesce(fault_type, '')) over w = coalesce(fault_type, '') and ts - lag(ts) over w = interval 1 hour, false) then 0 else 1 end fresh from res where status in ('SUSPECT', 'SENSOR_FAULT') window w as (partition by station_id, variable order by ts)))),
runs as (select station_id, variable, nullif(kind, '') fault_type, min(ts) s, max(ts) e, case when bool_or(status = 'SENSOR_FAULT') then 'SENSOR_FAULT' else 'SUSPECT' end status,
  ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][max(case severity when 'LOW' then 1 when 'MEDIUM' then 2 when 'HIGH' then 3 else 4 end)] severity, max(confidence) confidence,
  arg_max(struct_pack(v := value, c := corrected_value), struct_pack(a := coalesce(abs(value - corrected_value), 0), b := case when abs(value - corrected_value) > 0 then -epoch(ts) else epoch(ts) end)) peak, arg_max(trust, ts) trust_after from frun group by station_id, variable, kind, run),
fruns as (select r.*, coalesce(b.trust, 100) trust_before from runs r left join res b on b.station_id = r.station_id and b.variable = r.variable and b.ts = r.s - interval 1 hour),
gh as (select station_id, ts, max(confidence) confidence from res where status = 'GENUINE_EVENT' group by all),
sev as (select station_id, min(ts) s, max(ts) e, any_value(top) confidence from (select *, sum(fresh) over (partition by station_id order by ts) run, max(confidence) over (partition by station_id) top from (select *, case when ts - lag(ts) over (partition by station_id order by ts) = interval 1 hour then 0 else 1 end fresh from gh)) group by station_id, run),
wev0 as (select *, case when s <= max(e) over (order by s, station_id rows between unbounded preceding and 1 preceding) + interval 1 hour then 0 else 1 end fresh from sev),
wev as (select min(s) s, max(e) e, arg_min(station_id, struct_pack(s := s, i := station_id)) station_id, arg_min(confidence, struct_pack(s := s, i := station_id)) confidence, count(*) parts, string_agg(station_id, ', ' order by s, station_id) stations from (select *, sum(fresh) over (order by s, station_id) ev from wev0) group by ev)
"""

TS = "strftime(ts, '%Y-%m-%d %H:%M:%S') ts"


def sql(select: str) -> str:
    return CHAIN + select


def _off_grid() -> str:
    """CHAIN for readings at the times of their events: neighbours by the nearest reading within half an hour of each hour around, and by all readings within two hours."""
    before, rest = CHAIN.split("nb as (", 1)
    after = rest.split("\npat as (", 1)[1]
    near = """ask as (select a.station_id, a.ts, a.variable, a.anomaly, k as off, a.ts + to_hours(k) target, e.neighbour_id from anom a cross join (select unnest(range(-2, 3)) k) o join edges e on e.station_id = a.station_id),
hit as (select a.*, b.value from ask a join anom b on b.station_id = a.neighbour_id and b.variable = a.variable and b.ts >= a.target - interval 30 minute and b.ts <= a.target + interval 30 minute qualify row_number() over (partition by a.station_id, a.ts, a.variable, a.off, a.neighbour_id order by abs(epoch_us(b.ts) - epoch_us(a.target)), b.ts) = 1),
told as (select h.*, h.value - c.mean a from hit h join clim c on c.station_id = h.neighbour_id and c.m = month(h.target) and c.hr = hour(h.target) and c.variable = h.variable where h.value is not null and c.mean is not null),
zs as (select *, list_median(all_a) med from (select station_id, ts, variable, off, any_value(anomaly) anomaly, list(a) all_a, count(*) n from told group by all) where n >= 2),
zz as (select *, (anomaly - med) / (1.4826 * list_median(list_transform(all_a, lambda x: abs(x - med))) + mad_floor) z from zs join limits using (variable)),
spat as (select station_id, ts, variable, z, n, off, coalesce(abs(z) <= 3, false) consistent from zz qualify row_number() over (partition by station_id, ts, variable order by abs(z) nulls first, off) = 1),
nearby as (select h.station_id, h.ts, h.variable, list_median(list(b.anomaly)) near_anomaly from anom h join edges e on e.station_id = h.station_id join anom b on b.station_id = e.neighbour_id and b.variable = h.variable and b.ts >= h.ts - interval 2 hour and b.ts <= h.ts + interval 2 hour join limits l on l.variable = b.variable where b.value between l.lo and l.hi and b.anomaly is not null group by all),
pat as ("""
    return before.replace("station_id, hts ts, event_id, hk", "station_id, raw_ts ts, event_id, hk") + near + after


OFF_GRID = _off_grid()


def over_injected(injection: str, select: str) -> str:
    """CHAIN over readings that an injection has changed (laid: its result, with what was there before as true values and the kinds of fault as labels)."""
    head, tail = CHAIN.split("\ndew as (", 1)
    # the values themselves, not those shown
    changed = re.sub(r"round\((i_\w+\.x), 6\)", r"\1", injection).replace(" select b.station_id, strftime", " laid0 as (select b.station_id, b.ts, strftime", 1)
    laid = """, laid as (select l.station_id, l.ts, r.event_id, r.hk, l.temp_c, l.pressure_hpa, l.rh_pct, l.label_temp_c, l.label_pressure_hpa, l.label_rh_pct, l.event_id event_name, r.temp_c was_temp_c, r.pressure_hpa was_pressure_hpa, r.rh_pct was_rh_pct from laid0 l join readings r on r.station_id = l.station_id and r.ts = l.ts)"""
    return head.rstrip(",") + changed.replace(" laid0 as", ", laid0 as", 1) + ")" + laid + ",\ndew as (" + tail.replace("from readings)", "from laid)", 1) + select
