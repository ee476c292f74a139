"""Column functions: all stay inside whole-stage code generation."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from brontide.config import CONFIG, SEVERITIES, STATUSES, VARIABLES


def by_variable(values: dict, column: str | Column = "variable") -> Column:
    """The constant of each variable; null where there is none."""
    c = F.col(column) if isinstance(column, str) else column
    return reduce(lambda acc, v: acc.when(c == v, F.lit(values[v])), VARIABLES[1:], F.when(c == VARIABLES[0], F.lit(values[VARIABLES[0]])))


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * 6371.0) * F.asin(F.sqrt(a))


def km_between(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    """The same of numbers."""
    a = math.sin(math.radians(lat2 - lat1) / 2) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(a))


def dewpoint_c(temp: Column, rh: Column) -> Column:
    """Magnus formula; humidity at least a thousandth of a percent. Null where the formula has no value (sentinels)."""
    g = F.log(F.greatest(rh, F.lit(1e-3)) / 100.0) + F.try_divide(17.62 * temp, 243.12 + temp)
    return F.try_divide(243.12 * g, 17.62 - g)


def no_nan(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def in_range(value: Column, variable: str | Column = "variable") -> Column:
    lo, hi = ({v: CONFIG["range"][v][k] for v in VARIABLES} for k in (0, 1))
    return F.coalesce(value.between(by_variable(lo, variable), by_variable(hi, variable)), F.lit(False))


def is_missing(value: Column, variable: str | Column = "variable") -> Column:
    v = F.col(variable) if isinstance(variable, str) else variable
    return value.isNull() | F.coalesce(value.isin(*CONFIG["sentinels"]), F.lit(False)) | ((v == "pressure_hpa") & F.coalesce(value == 0, F.lit(False)))


def severity(sigma: Column, hard: Column | None = None, limits: tuple = CONFIG["sigma"]) -> Column:
    s = F.abs(F.coalesce(sigma, F.lit(0.0)))
    a, b, c = limits
    out = F.when(s >= c, "CRITICAL").when(s >= b, "HIGH").when(s >= a, "MEDIUM").otherwise("LOW")
    return out if hard is None else F.when(hard, "CRITICAL").otherwise(out)


def rank_of(names: tuple, c: Column) -> Column:
    """Position from 1 in the ordered names; null for others."""
    p = F.array_position(F.array(*map(F.lit, names)), c)
    return F.when(p > 0, p)


def worst(names: tuple, c: Column) -> Column:
    """Aggregate: the highest of the ordered names, null if there is none."""
    return F.element_at(F.array(*map(F.lit, names)), F.max(rank_of(names, c)).cast("int"))


def worst_status(c: Column) -> Column:
    return F.coalesce(worst(STATUSES, c), F.lit("NORMAL"))


def worst_severity(c: Column) -> Column:
    return worst(SEVERITIES, c)


def ratio(a: Column, b: Column, digits: int = 4) -> Column:
    return F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), digits)


def trust_band(trust: Column) -> Column:
    (h, a), (w, b), (d, c) = CONFIG["trust_bands"]
    return F.when(trust >= a, h).when(trust >= b, w).when(trust >= c, d).otherwise("FAILED")


def array_median(c: Column) -> Column:
    """Median of an array of doubles; null for an empty one."""
    s, n = F.array_sort(c), F.size(c)
    lo, hi = F.floor((n + 1) / 2).cast("int"), F.floor((n + 2) / 2).cast("int")
    return F.when(n > 0, (F.element_at(s, lo) + F.element_at(s, hi)) / 2)
