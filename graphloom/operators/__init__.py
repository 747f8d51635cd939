"""Operators of the engine: functions from DataFrames to DataFrames."""
