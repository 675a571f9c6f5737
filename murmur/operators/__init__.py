"""Table-to-table operators: DataFrames in, DataFrames out, no actions inside unless documented."""
