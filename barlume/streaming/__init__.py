"""Bars and indicators over streams."""
