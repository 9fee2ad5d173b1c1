"""Log structuring and columnar analysis on Spark."""
