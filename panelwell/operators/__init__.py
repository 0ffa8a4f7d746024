"""Operators: functions from DataFrame to DataFrame, meant for ``df.transform``."""
