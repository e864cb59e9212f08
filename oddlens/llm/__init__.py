"""Operators of a training-data pipeline, each a plan of Spark jobs over documents or pages."""
