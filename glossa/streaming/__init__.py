"""Keyed change events: the same rules in batch and on a stream."""
