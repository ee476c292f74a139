"""From signals to a verdict: status, confidence, severity, kind of fault, reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brontide.config import CONFIG, FAULTS, VARIABLES
from brontide.functions.scalars import by_variable, no_nan, severity
from brontide.operators.history import noise_limit


def decide(df: DataFrame, high: float = CONFIG["high"], suspect: float = CONFIG["suspect"], sigma: tuple = CONFIG["sigma"]) -> DataFrame:
    """df (hard, soft, z, consistent, ml_score, dev_sigma) with status, confidence and severity."""
    c = F.col
    ml = F.coalesce(no_nan(c("ml_score")), F.lit(0.0))
    z = F.abs(F.coalesce(no_nan(c("z")), F.lit(0.0)))
    apart, agree = F.coalesce(~c("consistent"), F.lit(False)), F.coalesce(c("consistent"), F.lit(False))
    top = ml >= high
    rules = [
        (c("hard"), "SENSOR_FAULT", 0.95 + 0.04 * ml, F.lit("CRITICAL")),
        (top & (apart | c("soft")), "SENSOR_FAULT", 0.6 + 0.4 * (ml + F.least(z / 6, F.lit(1.0))) / 2, None),
        (top & agree, "GENUINE_EVENT", 0.7 + 0.3 * ml, None),
        (top, "SUSPECT", F.least(F.lit(0.6), 0.3 + 0.3 * ml), None),
        ((ml >= suspect) & apart, "SUSPECT", 0.3 + 0.2 * (ml - suspect) / max(high - suspect, 1e-9), None),
    ]
    grade = severity(c("dev_sigma"), limits=sigma)

    def case(pick, default) -> Column:
        out = F
        for rule in rules:
            out = out.when(rule[0], pick(rule))
        return out.otherwise(default)

    return df.withColumns({
        "status": case(lambda r: F.lit(r[1]), F.lit("NORMAL")),
        "confidence": F.round(case(lambda r: r[2], F.lit(0.0)), 4),
        "severity": case(lambda r: grade if r[3] is None else r[3], F.lit(None).cast("string")),
    })


def fingerprint(df: DataFrame) -> DataFrame:
    """df (pattern columns, usual, fault_hint, missing, z) with fault_type: the first of nine rules that holds."""
    c = F.col
    v = c("value")
    soft = by_variable({x: CONFIG["rate"][x][0] for x in VARIABLES})
    jump = lambda a, b: F.abs(c(a) - (v if b is None else c(b))) if a != "value" else F.abs(v - c(b))
    three = (jump("lag1", "lag2") >= soft) & (jump("value", "lag2") < soft)
    four = (jump("lag2", "lag3") >= soft) & (jump("value", "lag3") < soft) & c("lag1").isNotNull()
    noisy = (c("residual6") > noise_limit(c("usual"))) & (c("std6") > noise_limit(c("usual")))
    drift = (F.abs("z") > CONFIG["z"]) & c("full_day") & (c("max_step") < soft) & (c("net_day") > by_variable(CONFIG["drift"]))
    lo, hi = (by_variable({x: CONFIG["range"][x][k] for x in VARIABLES}) for k in (0, 1))
    kind = (
        F.when(c("fault_hint").isin(*FAULTS), c("fault_hint"))
        .when(c("missing"), "DROPOUT")
        .when((v < lo) | (v > hi), "OUT_OF_RANGE")
        .when(c("flat"), "FROZEN")
        .when(three | four | (jump("value", "lag1") >= soft), "SPIKE")
        .when(noisy, "NOISE")
        .when(drift, "DRIFT")
        .when((c("seen") >= 2) & (F.abs(v - c("baseline")) >= 1.5 * soft), "SPIKE")
    )
    return df.withColumn("fault_type", kind)


def explain(df: DataFrame, most: int = 4) -> DataFrame:
    """df with reasons: the physical ones, the neighbours', the model's top features; distinct, at most four."""
    c = F.col
    spatial = F.when(c("n") > 0, F.format_string("%d neighbouring stations %s (z = %.1f)", "n", F.when(c("consistent"), "agree").otherwise("disagree"), F.coalesce("z", F.lit(0.0))))
    flags = F.when(F.size(F.coalesce("shap_top", F.array())) > 0, F.concat(F.lit("ML flag: "), F.array_join(F.transform("shap_top", lambda s: s["label"]), ", "))) if "shap_top" in df.columns else F.lit(None).cast("string")
    none = F.when(c("ml_score") >= 0.95, "The pattern is very unusual for this sensor").otherwise("No single strong signal")
    found = F.slice(F.array_distinct(F.array_compact(F.concat("physics_reasons", F.array(spatial, flags)))), 1, most)
    return df.withColumn("reasons", F.when(F.size(found) > 0, found).otherwise(F.array(none)))
