"""Trajectory analytics on Spark: DataFrame operators over detection and track tables."""
