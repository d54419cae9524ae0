"""Readers, writers and adapters from the driver's tables."""
