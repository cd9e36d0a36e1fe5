"""Operators over blocks, catalogs, metadata and vectors."""
