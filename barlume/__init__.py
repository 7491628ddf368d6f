"""Market-style bar analytics as Spark plans over a long (symbol, timestamp) panel."""
