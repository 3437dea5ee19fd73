"""Operators over DataFrames; each module states the plan it aims at."""
