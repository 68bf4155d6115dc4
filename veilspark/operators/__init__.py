"""World aggregates, list aggregates and the utility diff."""
