"""Readers, writers, the data dictionary and the SQL catalog."""
