"""Operator modules; each function is DataFrame in, DataFrame out."""
