"""Structured Streaming twins of the keyed state machines."""
