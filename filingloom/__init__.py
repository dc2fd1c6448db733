"""Tabular filings analytics on Spark: ordered grids, periods, long facts, retrieval and series operators."""
