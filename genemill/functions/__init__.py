"""Scalar and tail-probability helpers."""
