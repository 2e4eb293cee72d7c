"""foliant: page-to-book analytics on Spark."""
