"""Audit, calibration and scoring of interval forecasts over per-entity sequences, on Spark DataFrames."""
