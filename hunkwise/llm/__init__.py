"""Operators of a training-data pipeline: ten methods, each with a general interface and a thin query."""
