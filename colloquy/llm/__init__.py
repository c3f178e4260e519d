"""Operators for preparing training data, each a function from DataFrames to
a DataFrame. Nothing else in the library imports this sub-package."""
