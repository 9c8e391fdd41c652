"""Subpackage of lodestack: operators."""
