"""Readers, writers and the connector registry."""
