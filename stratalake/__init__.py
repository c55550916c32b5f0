"""Layered retail analytics on Spark: ingest, profile, check, repair, mask, aggregate, report."""
