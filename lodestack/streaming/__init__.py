"""Subpackage of lodestack: streaming."""
