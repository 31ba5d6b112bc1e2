"""Declarative flows: plugins, channels, segments, pipes and graphs."""
