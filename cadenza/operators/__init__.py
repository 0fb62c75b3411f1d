"""Operators: functions from DataFrames keyed by recording_id to DataFrames."""
