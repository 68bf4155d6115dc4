"""World aggregates over streams."""
