"""Tidemark: point-in-time analytics on plain Spark DataFrames.

Every operator is a function from DataFrames to a DataFrame.  Nothing in here
runs a Spark job unless its docstring says so; plans are left to Catalyst.
"""

__version__ = "0.1.0"
