"""Whole workflows over one or many recordings."""
