"""Column builders: window frames and scalar functions."""
