"""Registered queries: each operator over the given tables, with its SQL twin."""
