"""Operators for preparing training text at scale.

Nothing outside this folder, ``tests/llm`` and ``corpus_pipeline.py`` imports it.
"""
