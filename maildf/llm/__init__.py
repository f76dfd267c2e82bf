"""Operators for building language-model training data.

Nothing outside this subpackage imports it; ``queries`` and ``oracles`` hold the
registered queries and their SQL.
"""
