"""Term-structure analytics on Spark."""
