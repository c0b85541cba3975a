"""Files that a run publishes."""
