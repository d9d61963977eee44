"""DataFrame -> DataFrame analytics operators (column names are parameters)."""
