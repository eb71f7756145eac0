"""Operators: functions from DataFrame to DataFrame, keyed by track."""
