"""Early-warning analytics on Spark."""
