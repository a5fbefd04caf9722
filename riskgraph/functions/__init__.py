"""Scalar rules as column expressions and small vectorised functions."""
