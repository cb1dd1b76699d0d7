"""Market analytics as set-based Spark jobs on ``(symbol, date)`` tables."""
