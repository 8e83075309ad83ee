"""Metrics over streams: statistics that add up."""
