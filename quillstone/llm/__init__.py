"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it. Every module holds one operator
with a general interface; ``queries`` derives the registered result tables.
"""
