"""DataFrame to DataFrame operators over logs of versioned operations."""
