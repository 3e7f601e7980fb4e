"""Schemas and readers of landed files."""
