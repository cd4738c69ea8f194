"""DataFrame operators. They take and return DataFrames; none collects rows."""
