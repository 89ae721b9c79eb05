"""DataFrame-in, DataFrame-out operators of the retention pipeline."""
