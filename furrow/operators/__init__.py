"""Operators: functions from DataFrames to DataFrames, most of them usable on streams too."""
