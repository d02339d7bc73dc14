"""rillstore: ordered key-value runs and append-only event streams on Spark DataFrames."""
