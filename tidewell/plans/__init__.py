"""Queries of the engine and their SQL."""
