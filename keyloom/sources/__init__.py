"""Where variables are kept and found: the Parquet store, path templates, exports."""
