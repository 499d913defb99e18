"""Operators over patients and encounters: DataFrames in, DataFrames out."""
