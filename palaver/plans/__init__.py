"""Analytic plans: functions from DataFrames and parameters to a DataFrame."""
