"""Column functions: the record codec and the wire frames."""
