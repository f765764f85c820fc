"""Operators: pure functions from DataFrames to DataFrames, without collect or Python UDFs unless
their docstring says so."""
