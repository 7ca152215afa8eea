"""Operators that prepare text and vectors for training language models.

Nothing outside this subpackage imports it.
"""
