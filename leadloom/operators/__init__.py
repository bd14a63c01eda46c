"""DataFrame operators; key, order and column names are parameters."""
