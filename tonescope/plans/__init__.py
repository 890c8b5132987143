"""Composite questions built from operators."""
