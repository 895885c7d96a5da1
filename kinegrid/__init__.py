"""Driving-dynamics analytics and answer scoring as Spark DataFrame jobs."""
