"""Operators for preparing training text: filters, deduplication, archives, packing, scoring.

Nothing outside this package imports it. ``queries`` holds the registered queries.
"""
