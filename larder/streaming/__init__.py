"""Continuous ingest of sales drops and signups."""
