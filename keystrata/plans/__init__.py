"""Run metadata, pruning, and compaction plans."""
