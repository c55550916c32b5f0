"""DataFrame operators. Each takes frames and column names and returns a lazy frame."""
