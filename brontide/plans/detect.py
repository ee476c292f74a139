"""The whole detector as one batch plan: no loop over hours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brontide.config import CONFIG
from brontide.functions.scalars import array_median, by_variable, in_range
from brontide.operators import fusion, heal, history, physics, spatial
from brontide.operators.climatology import fit_climatology, with_climatology
from brontide.operators.evaluate import truth_rows
from brontide.operators.features import feature_frame, signal_features
from brontide.operators.forest import TOP, Forest, calibrate, contributions, fit_forest, score_forest, score_rows
from brontide.operators.geo import neighbour_edges
from brontide.operators.ingest import long_form

RESULT = ("station_id", "ts", "variable", "value", "status", "fault_type", "confidence", "severity", "reasons", "shap_top", "corrected_value", "trust", "scores")


def signals(readings: DataFrame, clim: DataFrame, edges: DataFrame, keep: tuple = (), on_grid: bool = True) -> DataFrame:
    """One row for each sensor and hour with rules, climatology, neighbours' verdict, pattern columns and extrapolation.

    The history is computed once: all of its windows share one deal by station, and what neighbours say needs the
    anomalies alone, which come straight from the readings. On a grid of hours neighbours are joined by equal hours; off it
    by the nearest reading to each hour around, and by all readings around for what a value should have been.
    """
    x = physics.check_physics(physics.rule_flags(history.sensor_history(readings, keep)))
    x = heal.extrapolate(history.usual_spread(history.pattern_columns(x)))
    if on_grid:
        anomalies = with_climatology(long_form(readings), clim)
        near = spatial.neighbour_signals(anomalies, spatial.around(anomalies, edges))
    else:
        near = spatial.offgrid_signals(readings, clim, edges)
    return with_climatology(x, clim).join(near, ["station_id", "ts", "variable"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def findings(sig: DataFrame, forest: Forest | None = None, keep: tuple = (), **limits) -> DataFrame:
    """sig and ml_score -> RESULT without trust; what only flagged rows need is a case that others don't enter. forest: what explains the
    scores, from the features beside them."""
    x = fusion.decide(sig, **limits)
    x = heal.impute(fusion.explain(fusion.fingerprint(x if forest is None else contributions(x, forest))))
    normal, fixed = F.col("status") == "NORMAL", F.col("status").isin("SENSOR_FAULT", "SUSPECT")
    none = lambda c, kind: F.when(~normal, F.col(c)).otherwise(F.lit(None).cast(kind))
    top = F.col("shap_top") if "shap_top" in x.columns else F.array().cast(TOP)
    x = x.withColumns({
        "fault_type": none("fault_type", "string"),
        "reasons": F.when(normal, F.array().cast("array<string>")).otherwise(F.col("reasons")),
        "shap_top": F.when(normal, F.array().cast(TOP)).otherwise(top),
        "corrected_value": F.when(fixed, F.col("corrected_value")),
        "scores": F.struct(
            F.when(F.col("hard"), 1.0).when(F.col("soft"), 0.5).otherwise(0.0).alias("physics"),
            F.get("rule_ids", F.lit(0)).alias("physics_rule"),
            F.col("ml_score").alias("iforest"),
            F.col("z").alias("spatial_z"),
            F.coalesce("dev_sigma", F.lit(0.0)).alias("dev_sigma"),
        ),
    })
    return x.select(*[c for c in RESULT if c != "trust"], *keep, *[c for c in ("event_id",) if c in x.columns])


def verdicts(sig: DataFrame, start: DataFrame | None = None, forest: Forest | None = None, **limits) -> DataFrame:
    """sig and ml_score -> RESULT. start: trust to go on from."""
    x = heal.trust_scores(findings(sig, forest, **limits), start)
    return x.select(*RESULT, *[c for c in ("event_id",) if c in x.columns])


class Model:
    """What training leaves: climatology, forest and the calibration of its scores."""

    def __init__(self, train: DataFrame, trees: int = CONFIG["trees"]):
        self.clim = fit_climatology(long_form(train).where(in_range(F.col("value"))))
        features = feature_frame(train, self.clim)
        self.forest = Forest(fit_forest(features, trees=trees))
        self.calibration = calibrate(features, self.forest)

    def score(self, readings: DataFrame) -> DataFrame:
        """station_id, ts, variable, ml_score and the features that explain it."""
        return score_forest(feature_frame(readings, self.clim), self.forest, self.calibration).drop("raw")

    def score_signals(self, signals: DataFrame) -> DataFrame:
        """signals, of a stream too, with ml_score and features."""
        return score_rows(signal_features(signals), self.forest, self.calibration)


def judged(readings: DataFrame, edges: DataFrame, clim: DataFrame, score, keep: tuple = (), on_grid: bool = True) -> DataFrame:
    """Signals and the model's scores of all sensors and hours."""
    return signals(readings, clim, edges, keep, on_grid).join(score(readings), ["station_id", "ts", "variable"])


def detect(readings: DataFrame, stations: DataFrame, train: DataFrame | None = None, trees: int = CONFIG["trees"], on_grid: bool = True) -> DataFrame:
    """READINGS -> RESULT with climatology and forest fitted on ``train`` (default: the readings themselves). on_grid: readings are at full hours."""
    model = Model(readings if train is None else train, trees)
    return verdicts(judged(readings, neighbour_edges(stations), model.clim, model.score, on_grid=on_grid), forest=model.forest)


def detect_at(readings: DataFrame, edges: DataFrame, clim: DataFrame, score, now, warmup_h: int = 24, keep_h: int = 7 * 24) -> DataFrame:
    """RESULT of the last ``warmup_h`` hours up to now, as after a jump of a replay: from the kept readings before, and the two hours ahead that neighbours' hours reach."""
    seconds = lambda h: F.timestamp_seconds(F.unix_timestamp(now) + h * 3600)
    near = readings.where((F.col("ts") > seconds(-keep_h)) & (F.col("ts") <= seconds(CONFIG["window_h"])))
    return verdicts(judged(near, edges, clim, score).where((F.col("ts") > seconds(-warmup_h)) & (F.col("ts") <= now)))


def preview(labelled: DataFrame, edges: DataFrame) -> DataFrame:
    """A detector that reads the labels: faulty rows are faults where a rule or |z| > 3 of raw values backs them, else suspects; storms are genuine."""
    truth = truth_rows(labelled)
    x = physics.check_physics(physics.rule_flags(history.sensor_history(labelled.select("station_id", "ts", "temp_c", "pressure_hpa", "rh_pct"))))
    near = edges.select("station_id", "neighbour_id").join(long_form(labelled.select("station_id", "ts", "temp_c", "pressure_hpa", "rh_pct")).where(in_range(F.col("value"))).withColumnRenamed("station_id", "neighbour_id"), "neighbour_id")
    stats = near.groupBy("station_id", "ts", "variable").agg(F.collect_list("value").alias("v")).where(F.size("v") >= CONFIG["min_neighbours"]).withColumn("med", array_median(F.col("v")))
    stats = stats.select("station_id", "ts", "variable", "med", array_median(F.transform("v", lambda a: F.abs(a - F.col("med")))).alias("mad"))
    x = x.join(stats, ["station_id", "ts", "variable"], "left").join(truth, ["station_id", "ts", "variable"])
    z = (F.col("value") - F.col("med")) / (1.4826 * F.col("mad") + by_variable(CONFIG["mad_floor"]))
    backed = F.col("hard") | F.col("soft") | F.coalesce(F.abs(z) > CONFIG["z"], F.lit(False))
    faulty, storm = F.col("label") != "NONE", F.coalesce(F.col("event_id").startswith("STORM"), F.lit(False))
    grade = F.create_map(*[F.lit(v) for kv in PREVIEW_SEVERITY.items() for v in kv])
    step = F.col("value") - F.col("lag1")
    facts = F.array_compact(F.array(
        F.when(F.col("missing"), F.concat("variable", F.lit(" is missing or a dropout value"))),
        F.when(F.abs(step) > 0, F.format_string("%s changed by %.2f since the last reading", "variable", step)),
        F.when(F.col("flatline"), F.format_string("%s has stayed at %.2f", "variable", "value")),
        F.when(F.col("med").isNotNull() & ~F.col("missing"), F.format_string("%.2f away from the neighbours' median", F.col("value") - F.col("med"))),
    ))
    out = x.select(
        "station_id", "ts", "variable", "value",
        F.when(faulty & backed, "SENSOR_FAULT").when(faulty, "SUSPECT").when(storm, "GENUINE_EVENT").otherwise("NORMAL").alias("status"),
        F.when(faulty, F.col("label")).alias("fault_type"),
        F.when(faulty & backed, 0.9).when(faulty, 0.5).when(storm, 0.85).otherwise(0.0).alias("confidence"),
        F.when(faulty & backed, grade[F.col("label")]).when(faulty, "MEDIUM").alias("severity"),
        F.when(faulty, F.col("true_value")).alias("corrected_value"),
        F.when(faulty | storm, facts).otherwise(F.array().cast("array<string>")).alias("reasons"),
        F.when(faulty | storm, F.struct(F.when(F.col("hard"), 1.0).when(F.col("soft"), 0.5).otherwise(0.0).alias("physics"), F.get("rule_ids", F.lit(0)).alias("physics_rule"), z.alias("spatial_z"))).alias("scores"),
    )
    return heal.trust_scores(out)


#: How grave a confirmed fault of each kind is in the preview.
PREVIEW_SEVERITY = {"SPIKE": "CRITICAL", "OUT_OF_RANGE": "CRITICAL", "DROPOUT": "HIGH", "FROZEN": "HIGH", "NOISE": "MEDIUM", "DRIFT": "MEDIUM"}
