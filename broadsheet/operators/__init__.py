"""DataFrame operators: every one takes and returns DataFrames and uses built-in expressions only."""
