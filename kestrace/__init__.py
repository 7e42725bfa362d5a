"""Trace sampling, trace analytics and training-data preparation as Spark plans."""
