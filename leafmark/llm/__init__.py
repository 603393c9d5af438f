"""Operators for building large training corpora."""
