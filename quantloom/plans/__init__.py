"""Operator graphs and weight recipes as DataFrame plans."""
