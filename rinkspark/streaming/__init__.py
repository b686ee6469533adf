"""Incremental and stateful operators."""
