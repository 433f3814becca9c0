"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it. Each module states what it does
with nulls, empty and very long texts, ties, repeated rows and empty tables.
"""
