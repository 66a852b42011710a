"""Composite datasets built from the operators."""
