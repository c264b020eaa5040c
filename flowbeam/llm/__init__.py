"""Operators for preparing training text: scans, filters, deduplication, scoring, mixing, output.

Each module holds one operator with its own interface; ``queries`` registers them over the
``documents`` tables. Nothing else in the package imports this subpackage.
"""
