"""Readers, writers and the parquet tables of a scale-factor folder."""
