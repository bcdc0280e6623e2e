"""Readers and writers: driver tables, shared-pool JSON lines, file stamps."""
