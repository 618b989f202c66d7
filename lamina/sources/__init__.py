"""Where records are read from and written to."""
