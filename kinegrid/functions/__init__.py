"""Column and window expressions: time series, text, statistics."""
