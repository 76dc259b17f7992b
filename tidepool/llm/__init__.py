"""Operators of a training-data pipeline over the ``documents`` and ``pages`` tables.

Nothing outside this subpackage imports it; ``queries.py`` holds the thin
registered queries, the other modules the operators themselves.
"""
