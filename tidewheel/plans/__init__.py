"""Jobs and read queries, as pure functions of DataFrames and an explicit as_of time."""
