"""Operators: functions from DataFrames to DataFrames. Nothing is collected; order is always an explicit column."""
