"""Operators on samples: functions of a table that return steps for a pipeline."""
