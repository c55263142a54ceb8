"""Operators for large training corpora: tokenising, near-duplicates, licences, secrets, mixing, search.

Nothing outside this subpackage imports it. ``queries`` holds the registered
queries and their SQL; each operator has a module of its own.
"""
