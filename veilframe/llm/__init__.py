"""Corpus preparation for language-model training: ten operators and their queries.

Nothing outside this folder imports it; it stands or falls as one piece.
"""
