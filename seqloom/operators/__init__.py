"""Operators on DataFrames, generic over column names."""
