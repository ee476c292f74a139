"""Names and default settings of the sensor engine. Ranges, limits and weights are those the results depend on."""

from __future__ import annotations

VARIABLES = ("temp_c", "pressure_hpa", "rh_pct")
STATUSES = ("NORMAL", "GENUINE_EVENT", "SUSPECT", "SENSOR_FAULT")
FLAGGED = ("SUSPECT", "SENSOR_FAULT")
FAULTS = ("SPIKE", "FROZEN", "DRIFT", "DROPOUT", "NOISE", "OUT_OF_RANGE")
SEVERITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")

#: The model features of a sensor and hour, in order.
FEATURES = ("value", "diff_1", "diff_3", "std_6", "std_24", "run_length", "dev_sigma", "dewpoint_value", "dewpoint_delta", "hour_sin", "hour_cos")

CONFIG = {
    "seed": 42,
    "splits": {"train": ("2022-01-01", "2023-12-31"), "val": ("2024-01-01", "2024-06-30"), "test": ("2024-07-01", "2024-12-31")},
    "coverage": 0.8,
    "max_gap": 2,
    "range": {"temp_c": (-30.0, 55.0), "pressure_hpa": (870.0, 1085.0), "rh_pct": (0.0, 102.0)},
    "sentinels": (-9999.0, -999.0),
    "rate": {"temp_c": (6.0, 10.0), "pressure_hpa": (3.0, 6.0), "rh_pct": (40.0, None)},
    "dewpoint_max": 35.0,
    "dewpoint_jump": 8.0,
    "flat_steps": {"temp_c": 6, "pressure_hpa": 12, "rh_pct": 6},
    "flat_ignore_rh": 98.0,
    "decoupled": {"temp_c": 6.0, "pressure_hpa": 0.5, "rh_pct": 3.0},
    "radius_km": 150.0,
    "min_neighbours": 2,
    "window_h": 2,
    "z": 3.0,
    "mad_floor": {"temp_c": 0.5, "pressure_hpa": 0.5, "rh_pct": 3.0},
    "std_floor": {"temp_c": 0.3, "pressure_hpa": 0.5, "rh_pct": 2.0},
    "trees": 200,
    "subsample": 256,
    "high": 0.97,
    "suspect": 0.9,
    "sigma": (3.0, 6.0, 10.0),
    "trust_start": 100.0,
    "trust_recovery": 0.5,
    "trust_penalty": {"LOW": 2.0, "MEDIUM": 5.0, "HIGH": 10.0, "CRITICAL": 20.0},
    "trust_bands": (("HEALTHY", 80.0), ("WATCH", 50.0), ("DEGRADED", 25.0)),
    "drift": {"temp_c": 1.0, "pressure_hpa": 1.0, "rh_pct": 5.0},
    "impute": (0.7, 0.3),
    "margin": {"temp_c": 5.0, "pressure_hpa": 10.0, "rh_pct": 5.0},
    "storm": {"radius_km": 80.0, "speed_kmh": 30.0, "onset_h": 2, "relax_h": 6, "tau_h": 3.0, "temp_drop": 7.0, "rh_rise": 25.0, "pressure_rise": 2.5},
}
