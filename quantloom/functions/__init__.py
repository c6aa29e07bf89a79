"""Batch functions over series, and scalar helpers as column expressions."""
