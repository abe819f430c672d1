"""Sources of messages and chunks."""
