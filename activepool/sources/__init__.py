"""Readers and writers. Schemas are given, never inferred; text files keep a line order key."""
