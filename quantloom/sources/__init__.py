"""Bars, adjustment factors and universes as DataFrames."""
