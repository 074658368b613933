"""Scans of files into DataFrames, and sinks with their guards."""
