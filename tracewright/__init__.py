"""Research-provenance analytics on Spark."""
