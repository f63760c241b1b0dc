"""Commerce payment analytics built from Spark DataFrame operations."""
