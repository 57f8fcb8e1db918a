"""Training-data operators built on Spark; nothing else in the library imports this package."""
