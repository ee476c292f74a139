"""The physical rules of a reading, as flags, ids and reasons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brontide.config import CONFIG, VARIABLES
from brontide.functions.scalars import by_variable, is_missing

RULES = ("MISSING", "RANGE", "ROC", "DEWPOINT_MAX", "DEWPOINT_JUMP", "FLATLINE", "DECOUPLED")


def rule_flags(history: DataFrame) -> DataFrame:
    """history with one boolean for each rule; ROC has a soft and a hard one. A missing reading breaks no other rule."""
    v, var = F.col("value"), F.col("variable")
    lo, hi = (by_variable({x: CONFIG["range"][x][k] for x in VARIABLES}) for k in (0, 1))
    soft, hard = (by_variable({x: CONFIG["rate"][x][k] for x in VARIABLES}) for k in (0, 1))
    hours = F.greatest((F.unix_micros("ts") - F.unix_micros("prev_ts")) / 3.6e9, F.lit(1e-9))
    rate = F.abs(v - F.col("lag1")) / hours
    missing = is_missing(v)
    then = lambda c: ~missing & F.coalesce(c, F.lit(False))
    return history.withColumns({
        "missing": missing,
        "out_of_range": then((v < lo) | (v > hi)),
        "roc_soft": then(rate > soft),
        "roc_hard": then(rate > hard),
        "dewpoint_max": then(F.col("dewpoint") > CONFIG["dewpoint_max"]),
        "dewpoint_jump": then(F.abs(F.col("dewpoint") - F.col("prev_dewpoint")) > CONFIG["dewpoint_jump"]),
        "flatline": then(F.col("flat")),
        "apart": then(F.col("decoupled") & (var == "temp_c")),
    })


def check_physics(flags: DataFrame) -> DataFrame:
    """flags with hard, soft, rule_ids (in the order of RULES), reasons and fault_hint."""
    c = F.col
    hit = (c("missing"), c("out_of_range"), c("roc_soft") | c("roc_hard"), c("dewpoint_max"), c("dewpoint_jump"), c("flatline"), c("apart"))
    ids = F.array_compact(F.array(*[F.when(h, r) for h, r in zip(hit, RULES, strict=True)]))
    step = F.abs(c("value") - c("lag1"))
    texts = (
        F.format_string("%s is missing or a dropout value", "variable"),
        F.format_string("%s=%.2f is outside the physical range", "variable", "value"),
        F.format_string("%s changed by %.2f since the last reading", "variable", step),
        F.format_string("The implied dewpoint of %.1f °C is more than air can hold", "dewpoint"),
        F.format_string("The implied dewpoint changed by %.1f °C", F.abs(c("dewpoint") - c("prev_dewpoint"))),
        F.format_string("%s has stayed at %.2f", "variable", "value"),
        F.format_string("Temperature jumped by %.1f °C alone", step),
    )
    return flags.withColumns({
        "hard": c("missing") | c("out_of_range") | c("roc_hard") | c("dewpoint_max") | c("flatline"),
        "soft": c("roc_soft") | c("dewpoint_jump") | c("apart"),
        "rule_ids": ids,
        "physics_reasons": F.array_compact(F.array(*[F.when(h, t) for h, t in zip(hit, texts, strict=True)])),
        "fault_hint": F.when(c("missing"), "DROPOUT").when(c("flatline"), "FROZEN").when(c("out_of_range"), "OUT_OF_RANGE"),
    })
