"""Panel research on Spark: bars, features, labels, books, backtests and their statistics as DataFrame jobs."""
