"""Operators of a training-data pipeline over text tables, each a Spark job."""
