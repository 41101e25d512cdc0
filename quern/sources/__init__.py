"""Stores, imports and result formats."""
