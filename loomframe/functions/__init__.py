"""Scalar functions and byte codecs."""
