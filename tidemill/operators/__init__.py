"""Operators: functions from DataFrames to DataFrames, for batches and, where the text says so, for streams."""
