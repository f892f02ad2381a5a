"""Operators over the log: views, writes, segments, compaction, requests, replication."""
