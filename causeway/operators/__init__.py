"""Operators on event-time tables; each takes and returns DataFrames."""
