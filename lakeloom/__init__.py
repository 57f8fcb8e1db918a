"""Lakeloom: an analytics engine on the DataFrame, SQL and Structured Streaming APIs."""
