"""Operators for preparing training text: near copies, quality, privacy, mixing, tokens.

Nothing outside this package imports it. Every operator takes a frame with ``doc_id`` and
``text``; other columns are ignored, so their names cannot clash with the operator's own.
"""
