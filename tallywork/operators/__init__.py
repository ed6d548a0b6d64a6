"""Analytical operators: functions from DataFrames and parameters to a DataFrame."""
