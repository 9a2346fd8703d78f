"""Analytics over agent-run telemetry and text corpora, on Spark."""
