"""Operators of a training-data pipeline, each one a Spark job over the ``documents`` or ``pages`` table."""
