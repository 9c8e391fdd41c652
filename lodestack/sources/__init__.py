"""Subpackage of lodestack: sources."""
