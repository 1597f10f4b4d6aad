"""Column expressions: paths, sizes, durations."""
