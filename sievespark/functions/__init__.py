"""Scalar functions on ids, words and policies."""
