"""lodeframe: evidence-grounded prediction analytics as Spark plans."""
