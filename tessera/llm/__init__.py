"""Operators for building language-model training corpora.

Nothing outside this subpackage imports it.  Every operator is a module with a
general DataFrame interface; ``queries`` holds the thin registered queries.
"""
