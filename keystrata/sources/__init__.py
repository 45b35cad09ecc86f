"""Durable tables: Parquet runs under a manifest, and readers of binary layouts."""
