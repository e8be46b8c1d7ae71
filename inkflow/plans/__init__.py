"""Sequence plans: global offsets, count windows, shards and splits."""
