"""Wallet-transaction profiling on Spark: every function takes and returns DataFrames."""
