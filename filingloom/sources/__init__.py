"""Scans and sinks of tabular filings."""
