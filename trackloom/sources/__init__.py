"""Readers: directories of logs to tables."""
