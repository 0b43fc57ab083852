"""Time series, ledgers and resampling inference as Spark DataFrame queries."""
