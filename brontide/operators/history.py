"""Window columns over each sensor's past: differences, runs, rolling statistics. Previous means previous row, not hour."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from brontide.config import CONFIG, VARIABLES
from brontide.functions.scalars import by_variable, dewpoint_c
from brontide.operators.ingest import long_form


def by_station():
    return Window.partitionBy("station_id").orderBy("ts")


def by_sensor():
    return Window.partitionBy("station_id", "variable").orderBy("ts")


def sensor_history(readings: DataFrame, keep: tuple = ()) -> DataFrame:
    """Long form with what the rules need: dewpoints, sibling differences, lags and flat stretches.

    One deal by station serves all windows: those by sensor need no other exchange.
    """
    r = readings.repartition("station_id")
    r = r.withColumn("dewpoint", dewpoint_c(F.col("temp_c"), F.col("rh_pct")))
    lag = lambda c, k=1: F.lag(c, k).over(by_station())
    step = {v: F.abs(F.col(v) - lag(v)) for v in VARIABLES}
    t, p, h = (CONFIG["decoupled"][v] for v in VARIABLES)
    r = r.withColumns({
        "prev_dewpoint": lag("dewpoint"),
        "prev_ts": lag("ts"),
        "decoupled": F.coalesce((step["temp_c"] > t) & (step["pressure_hpa"] <= p) & (step["rh_pct"] <= h), F.lit(False)),
    })
    x = long_form(r, (*keep, "dewpoint", "prev_dewpoint", "prev_ts", "decoupled"))
    back = lambda n: by_sensor().rowsBetween(1 - n, 0)
    v = F.col("value")

    def flat(n):
        w = back(n)
        return (F.count("*").over(w) == n) & (F.count(v).over(w) == n) & (F.min(v).over(w) == F.max(v).over(w))

    lags = {f"lag{k}": F.lag(v, k).over(by_sensor()) for k in (1, 2, 3)}
    steps = CONFIG["flat_steps"]
    x = x.withColumns(lags | {"seen": F.row_number().over(by_sensor()), "flat_short": flat(steps["temp_c"]), "flat_long": flat(steps["pressure_hpa"])})
    still = F.when(F.col("variable") == "pressure_hpa", F.col("flat_long")).otherwise(F.col("flat_short"))
    return x.withColumn("flat", F.coalesce(still & ~((F.col("variable") == "rh_pct") & (v >= CONFIG["flat_ignore_rh"])), F.lit(False))).drop("flat_short", "flat_long")


def same_value_run(long: DataFrame) -> DataFrame:
    """run: how many equal readings in a row end here; a null counts 1."""
    v = F.col("value")
    fresh = F.coalesce((v != F.lag(v).over(by_sensor())), F.lit(True)).cast("int")
    out = long.withColumn("_run", F.sum(fresh).over(by_sensor()))
    return out.withColumn("run", F.row_number().over(Window.partitionBy("station_id", "variable", "_run").orderBy("ts"))).drop("_run")


def pattern_columns(history: DataFrame) -> DataFrame:
    """What naming a fault needs beyond the rules: spread, detrended spread, baseline, drift."""
    v = F.col("value")
    back = lambda n: by_sensor().rowsBetween(1 - n, 0)
    six, day, steps, past = back(6), back(24), by_sensor().rowsBetween(-22, 0), by_sensor().rowsBetween(-26, -3)
    n = F.col("seen").cast("double")
    full = F.count(v).over(six) == 6
    rest = F.regr_syy(v, n).over(six) - F.try_divide(F.pow(F.regr_sxy(v, n).over(six), F.lit(2)), F.regr_sxx(v, n).over(six))
    return history.withColumns({
        "std6": F.when(full, F.stddev_samp(v).over(six)),
        "loose6": F.when(F.count(v).over(six) >= 4, F.stddev_samp(v).over(six)),
        "residual6": F.when(full, F.sqrt(F.greatest(rest, F.lit(0.0)) / 5)),
        "baseline": F.when(F.count(v).over(past) >= 3, F.percentile(v, F.lit(0.5)).over(past)),
        "all_std": F.stddev_samp(v).over(by_sensor().rowsBetween(Window.unboundedPreceding, 0)),
        "full_day": F.count(v).over(day) == 24,
        "max_step": F.max(F.abs(v - F.col("lag1"))).over(steps),
        "net_day": F.abs(v - F.lag(v, 23).over(by_sensor())),
    })


def prefix_order(values: np.ndarray, upto: np.ndarray, k: np.ndarray) -> np.ndarray:
    """For each query the value with ``k`` smaller ones among the first ``upto`` values, by a wavelet matrix.

    Values are replaced by their ranks; level by level, from the highest bit, a stable partition puts those without the
    bit first, and counts of them before each place lead all queries to the next level at once.
    """
    order = np.argsort(values, kind="stable")
    left = np.empty(len(values), dtype=np.int64)
    left[order] = np.arange(len(values))
    first, last, k, rank = np.zeros_like(upto), upto.copy(), k.copy(), np.zeros_like(upto)
    for bit in range(max(1, len(values) - 1).bit_length() - 1, -1, -1):
        on = (left >> bit) & 1
        zeros = np.append(0, np.cumsum(1 - on))
        here = zeros[last] - zeros[first]
        up = k >= here
        rank |= up.astype(np.int64) << bit
        k = np.where(up, k - here, k)
        first, last = (np.where(up, zeros[-1] + x - zeros[x], zeros[x]) for x in (first, last))
        left = np.concatenate([left[on == 0], left[on == 1]])
    return values[order][rank] if len(values) else np.zeros(0)


def prefix_medians(values: np.ndarray) -> np.ndarray:
    """The median of the numbers up to each place, NaN before the first number; NaNs among them don't count."""
    count = np.cumsum(~np.isnan(values))
    own, some = values[~np.isnan(values)], np.flatnonzero(count)
    n = count[some]
    out = np.full(len(values), np.nan)
    out[some] = (prefix_order(own, n, (n - 1) // 2) + prefix_order(own, n, n // 2)) / 2
    return out


def usual_spread(patterns: DataFrame) -> DataFrame:
    """usual: the median so far of the six-row spreads up to six rows ago, or up to 12 rows the spread of all.

    A growing window frame would sort all of it for every row. Here one order-statistics structure answers for all rows of a
    sensor at once, in n log n, without a loop over rows. The rows pass through whole, dealt as the windows before have
    them, so nothing is joined back; a task holds one sensor's history, which grows with its years, not with the number of sensors.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(table["seen"].to_numpy(), kind="stable")))
        spreads, whole = (table[c].to_numpy(zero_copy_only=False).astype(float) for c in ("loose6", "all_std"))
        usual = prefix_medians(np.concatenate([np.full(6, np.nan), spreads])[: table.num_rows])
        usual[:12] = whole[:12]
        return table.append_column("usual", pa.array(usual, pa.float64(), mask=np.isnan(usual)))

    return patterns.groupBy("station_id", "variable").applyInArrow(run, StructType([*patterns.schema.fields, StructField("usual", DoubleType())]))


def noise_limit(usual):
    return F.when(usual.isNotNull(), 3.0 * F.greatest(usual, F.lit(1e-6)))


def flat_steps(variable="variable"):
    return by_variable(CONFIG["flat_steps"], variable)
