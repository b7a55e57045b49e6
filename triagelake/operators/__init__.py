"""Operators: DataFrame in, DataFrame (or Column over a row's structs) out."""
