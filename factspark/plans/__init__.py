"""Rules as data, their planner, and their compilation to DataFrames."""
