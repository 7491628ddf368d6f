"""Indicators, rules, backtests, sweeps, scanners, learning and options."""
