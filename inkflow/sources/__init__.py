"""Readers, source mixing, filters and the shard sink."""
