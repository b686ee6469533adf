"""Composed queries: the registered catalogue, flows and lifecycles."""
