"""Subpackage of lodestack: functions."""
