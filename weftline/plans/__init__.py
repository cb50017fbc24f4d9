"""Declarative job specifications folded into DataFrames."""
