"""Readers and writers for index files, logs, reports and tables."""
