"""Whole runs: from sales history to published plan and advisory tables."""
