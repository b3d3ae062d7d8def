"""Readers, writers and the shared folder for tables between jobs."""
