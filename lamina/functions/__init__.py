"""Column and frame helpers."""
