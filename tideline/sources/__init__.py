"""Readers and writers: archives, table profiles, state tables, logs."""
