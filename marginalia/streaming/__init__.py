"""Limits, job states and windows over streams."""
