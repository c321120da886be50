"""Sources: JSON lines, Parquet footers, Python calls, and tables as records."""
