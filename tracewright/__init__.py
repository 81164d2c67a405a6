"""Process analytics on Spark."""
