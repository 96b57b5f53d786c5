"""Readers and writers: files, topics, tables, and the mapping of the test tables."""
