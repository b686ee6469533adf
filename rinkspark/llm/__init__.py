"""Operators for large text corpora: scans, near-duplicates, classifiers, search and tokens.

Nothing outside this subpackage imports it.
"""
