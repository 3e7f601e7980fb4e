"""DataFrame operators: first and last rows of keys, top rows, pages, lookups, differences, merges."""
