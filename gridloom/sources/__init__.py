"""Readers and writers: vendor directories, metric inputs, Parquet outputs."""
