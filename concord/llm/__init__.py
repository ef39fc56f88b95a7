"""Operators of a training-data pipeline, as Spark jobs.

Each module holds one operator: a general interface on DataFrames, with the
defined results of its edge cases in its docstring.  ``queries`` applies them to
the test tables.  Nothing outside this package imports it.
"""
