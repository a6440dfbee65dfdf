"""Operators for preparing training data, and the queries that apply them to whole tables.

Nothing else in the library imports this subpackage. One module per operator; ``queries.py`` holds
the registered queries and their SQL; ``arrow.py`` the helpers that the Python-backed operators share.
"""
