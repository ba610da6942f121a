"""Catalog analytics on Spark: the data work behind a large registry of datasets."""
