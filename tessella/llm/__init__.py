"""Operators for building language-model training data at cluster scale.

Nothing outside this subpackage imports it.  ``queries.py`` holds the thin
``opN_*`` queries and their SQL.
"""
