"""Scale patterns: how ordered work on one very long series is spread over many tasks."""
