"""Declarative data workflows as Spark jobs.

Every operator is a function from DataFrames and keyword arguments to a DataFrame.
"""
