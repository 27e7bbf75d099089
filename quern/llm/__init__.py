"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  ``queries`` registers the ten
operators; every other module holds one operator with its own interface.
"""
