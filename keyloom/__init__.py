"""Keyloom: versioned scientific variables and batch dataflow on Spark DataFrames."""
