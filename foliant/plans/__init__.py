"""The catalogue of queries and whole-book plans."""
