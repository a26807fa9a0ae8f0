"""Whole flows: search, ingestion, maintenance; and the driver tables as their data."""
