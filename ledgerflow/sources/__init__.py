"""Schemas, readers, stand-in views and sinks."""
