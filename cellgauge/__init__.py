"""Distributional calibration of cell measurements as Spark DataFrame jobs."""
