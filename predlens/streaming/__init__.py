"""Time buckets, the one operator here that also runs on an unbounded frame."""
