"""DataFrame operators: each takes DataFrames and returns DataFrames, without actions unless its docstring says so."""
