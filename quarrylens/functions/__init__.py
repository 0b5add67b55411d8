"""Scalar expressions and functions."""
