"""Whole runs over several tables."""
