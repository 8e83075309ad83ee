"""Pipelines of steps, datasets and evaluations."""
