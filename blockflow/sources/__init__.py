"""Readers and writers: CSV / Parquet / polygon sources, dimension tables, sinks."""
