"""Operators over graph relations; each takes and returns DataFrames."""
