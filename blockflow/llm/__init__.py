"""Operators for preparing training corpora.

Nothing else in the library imports this subpackage; ``queries`` holds the
registered queries, every other module one operator with a general interface.
"""
