"""State over time: sliding limits and expiring entries, in batch and as streams."""
