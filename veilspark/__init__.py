"""Private analytics on Spark: 64-world noised aggregation, policies, admission and utility diff."""
