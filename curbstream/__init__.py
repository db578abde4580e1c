"""Trajectory and event analytics on Spark."""
