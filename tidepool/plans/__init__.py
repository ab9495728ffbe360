"""Whole queries built of operators."""
