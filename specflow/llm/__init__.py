"""Operators for preparing training text: scoring, filtering, de-duplication and tokenisation of documents.

Nothing outside this subpackage imports it.
"""
