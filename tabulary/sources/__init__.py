"""Readers and writers for registered tables, request logs and metric files."""
