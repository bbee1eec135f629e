"""Registered queries by group."""
