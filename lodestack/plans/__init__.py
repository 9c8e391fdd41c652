"""Subpackage of lodestack: plans."""
