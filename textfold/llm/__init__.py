"""Operators for large training-data pipelines (tokens, licences, dedup, search, language, extraction, mixing).

Nothing else in the library imports this subpackage.
"""
