"""Operators: DataFrame to DataFrame, lazy, column roles as parameters."""
