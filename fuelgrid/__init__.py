"""Retail price panels on Spark: sources, operators, models, indices and streams as DataFrame functions."""
