"""Operators on DataFrames: buckets, sampling plans, vector quantisation, losses, metrics, telemetry."""
