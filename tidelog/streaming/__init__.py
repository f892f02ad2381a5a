"""Streaming maintenance of the key index."""
