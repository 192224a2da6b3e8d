"""Leakage-safe cohort construction and paired model evaluation on Spark."""
