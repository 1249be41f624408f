"""Scalar functions on colours, sizes and names, as column expressions."""
