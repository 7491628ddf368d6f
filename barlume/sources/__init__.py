"""Bars: their contract, where they come from, where they are kept."""
