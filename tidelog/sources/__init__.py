"""Readers and writers of raw segment and index bytes."""
