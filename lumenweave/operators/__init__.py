"""DataFrame to DataFrame operations."""
