"""Feeds, configuration, registries and sinks."""
