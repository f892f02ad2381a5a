"""Operators for corpora that models are trained on. Nothing else in the library imports this."""
