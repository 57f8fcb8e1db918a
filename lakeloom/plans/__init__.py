"""The SQL dialect, versioned tables and cost decisions."""
