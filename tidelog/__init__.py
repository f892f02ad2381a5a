"""Tidelog: a log-structured keyed table evaluated with DataFrame expressions."""
