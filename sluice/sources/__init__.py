"""Readers and writers: explicit schemas, nothing inferred."""
