"""Scorecards against labels, and the threshold sweep."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brontide.config import FAULTS, FLAGGED, VARIABLES
from brontide.functions.scalars import ratio
from brontide.operators.summary import run_numbers


def truth_rows(labelled: DataFrame) -> DataFrame:
    """station_id, ts, event_id, variable, label, true_value from the wide labelled table."""
    parts = ", ".join(f"'{v}', label_{v}, orig_{v}" for v in VARIABLES)
    return labelled.select("station_id", "ts", "event_id", F.expr(f"stack(3, {parts}) as (variable, label, true_value)"))


def align(results: DataFrame, labelled: DataFrame) -> DataFrame:
    return results.join(truth_rows(labelled), ["station_id", "variable", "ts"])


def _flags(aligned: DataFrame) -> DataFrame:
    return aligned.withColumns({"flagged": F.col("status").isin(*FLAGGED), "clean": F.col("label") == "NONE", "storm": F.coalesce(F.col("event_id").startswith("STORM"), F.lit(False))})


def fault_scores(aligned: DataFrame) -> DataFrame:
    """Per kind of fault: events, tp, fp (runs), fn, precision, recall, f1."""
    x = _flags(aligned)
    hits = x.where(~F.col("clean")).groupBy("label", "variable", "event_id").agg(F.bool_or("flagged").alias("hit")).groupBy("label").agg(F.count_if("hit").alias("tp"), F.count_if(~F.col("hit")).alias("fn"))
    # runs are counted among the false flags of one kind, whatever flags lie between
    w = Window.partitionBy("station_id", "variable", "fault_type").orderBy("ts")
    false = run_numbers(x.where("flagged and clean and fault_type is not null"), w)
    fp = false.select("station_id", "variable", "fault_type", "run").distinct().groupBy(F.col("fault_type").alias("label")).agg(F.count("*").alias("fp"))
    kinds = aligned.sparkSession.createDataFrame([(f,) for f in FAULTS], "label string")
    n = lambda c: F.coalesce(c, F.lit(0))
    out = kinds.join(hits, "label", "left").join(fp, "label", "left").select(F.col("label").alias("fault_type"), n("tp").alias("tp"), n("fp").alias("fp"), n("fn").alias("fn"))
    out = out.withColumns({"events": F.col("tp") + F.col("fn"), "precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def overall_rates(aligned: DataFrame) -> DataFrame:
    """One row: false alarm rates in normal and storm hours, accuracy of the kind of fault (null if nothing was caught)."""
    x = _flags(aligned)
    fault, caught = F.col("status") == "SENSOR_FAULT", F.col("flagged") & ~F.col("clean")
    calm, stormy = F.col("clean") & ~F.col("storm"), F.col("clean") & F.col("storm")
    return x.agg(
        ratio(F.count_if(fault & calm), F.count_if(calm)).alias("false_alarm_rate_normal"),
        ratio(F.count_if(fault & stormy), F.count_if(stormy)).alias("false_alarm_rate_storm"),
        F.round(F.try_divide(F.count_if(caught & F.coalesce(F.col("fault_type") == F.col("label"), F.lit(False))), F.count_if(caught)), 4).alias("fault_type_accuracy"),
    )


def impute_error(aligned: DataFrame) -> DataFrame:
    """Mean absolute error of corrected values per variable, null where none was corrected."""
    x = _flags(aligned).where("flagged and not clean and corrected_value is not null and true_value is not null")
    e = x.groupBy("variable").agg(F.round(F.avg(F.abs(F.col("corrected_value") - F.col("true_value"))), 4).alias("mae"))
    return aligned.sparkSession.createDataFrame([(v,) for v in VARIABLES], "variable string").join(e, "variable", "left")


def mean_latency(results: DataFrame) -> DataFrame:
    return results.agg(F.round(F.avg(F.expr("try_cast(latency_ms as double)")), 2).alias("latency_ms_mean"))


#: Thresholds high and suspect, and limits of severity, to be tried.
GRID = (0.97, 0.98, 0.985, 0.99, 0.995), (0.90, 0.93, 0.95, 0.97), ((3.0, 6.0, 10.0), (2.5, 5.0, 8.0), (3.5, 7.0, 12.0))


def sweep(scores: DataFrame, highs: tuple = GRID[0], suspects: tuple = GRID[1], sigmas: tuple = GRID[2]) -> DataFrame:
    """scores (ml_score, label, is_storm) under every combination of limits with suspect < high, in one pass over the rows.

    The rows are summed up by score band and label before the combinations are joined, so the pass does not grow with their
    number. Limits of severity change no flag; they are carried along.
    """
    cuts = sorted({*highs, *suspects})
    band = F.lit(0)
    for c in cuts:
        band = band + (F.col("ml_score") >= c).cast("int")
    faulty = F.col("label") != "NONE"
    bands = scores.groupBy(band.alias("band")).agg(F.count_if(faulty).alias("faulty"), F.count_if(F.col("is_storm") & ~faulty).alias("storm"), F.count_if(~F.col("is_storm") & ~faulty).alias("clean"), *[F.count_if(F.col("label") == f).alias(f"n_{f}") for f in FAULTS])
    pairs = scores.sparkSession.createDataFrame([(h, s, g, cuts.index(h) + 1, cuts.index(s) + 1) for h in highs for s in suspects if s < h for g in map(list, sigmas)], "high double, suspect double, sigma array<double>, h int, s int")
    hit = F.col("band") >= F.col("s")
    n = lambda cond, c: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0))
    # neighbours are taken to disagree exactly at faults, so clean and storm rows are never flagged: no row counts as fp or false alarm
    out = pairs.join(F.broadcast(bands), hit | ~hit).groupBy("high", "suspect", "sigma").agg(n(hit, "faulty").alias("tp"), n(~hit, "faulty").alias("fn"), *[x for f in FAULTS for x in (n(hit, f"n_{f}").alias(f"hit_{f}"), n(F.lit(True), f"n_{f}").alias(f"all_{f}"))])
    per_fault = F.map_from_entries(F.filter(F.array(*[F.when(F.col(f"all_{f}") > 0, F.struct(F.lit(f).alias("key"), F.round(F.col(f"hit_{f}") / F.col(f"all_{f}"), 4).alias("value"))) for f in FAULTS]), lambda x: x.isNotNull()))
    out = out.withColumns({"precision": ratio(F.col("tp"), F.col("tp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn")), "fp": F.lit(0).cast("long"), "storm_far": F.lit(0.0), "normal_far": F.lit(0.0), "per_fault_recall": per_fault})
    p, r = F.try_divide(F.col("tp"), F.col("tp")), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    return out.withColumn("f1", ratio(2 * p * r, p + r)).drop(*[f"{k}_{f}" for f in FAULTS for k in ("hit", "all")])


def best_pair(swept: DataFrame) -> DataFrame:
    """The highest f1 among combinations with a storm rate up to 0.05, else up to 0.1, else all."""
    tier = F.when(F.col("storm_far") <= 0.05, 0).when(F.col("storm_far") <= 0.1, 1).otherwise(2)
    return swept.orderBy(tier, F.desc("f1"), "storm_far", "high", "suspect", "sigma").limit(1)


def scorecard_tiles(overall: DataFrame, latency: DataFrame) -> DataFrame:
    """name, value, text: the overall rates as percentages and the mean check time, a dash where nothing was measured."""
    named = "stack(3, 'False alarms during storms', false_alarm_rate_storm, 'False alarms, normal weather', false_alarm_rate_normal, 'Fault type named correctly', fault_type_accuracy) as (name, value)"
    rates = overall.select(F.expr(named)).withColumn("text", F.format_string("%.1f%%", F.col("value") * 100))
    time = latency.select(F.lit("Mean check time").alias("name"), F.col("latency_ms_mean").alias("value"), F.format_string("%.0f ms", "latency_ms_mean").alias("text"))
    both = rates.unionByName(time)
    return both.withColumn("text", F.when(F.col("value").isNotNull(), F.col("text")).otherwise("-"))
