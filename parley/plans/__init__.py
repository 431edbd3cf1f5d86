"""Registered queries: each binds library operators to the supplied tables."""
