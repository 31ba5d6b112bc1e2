"""Event-only logs as streams."""
