"""Operators of a training-data pipeline: tokens, duplicates, leaks, personal data, licences, quality and web archives.

Nothing outside this subpackage imports it. ``tessera.llm.queries`` registers its queries.
"""
