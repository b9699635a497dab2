"""Readers of the files that the domain publishes, and writers of results, all by Spark's own formats."""
