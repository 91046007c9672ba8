"""Operators for preparing training data; each module holds one operator.

Nothing outside this folder imports it. ``queries`` registers one query per
operator, ``corpus_pipeline.py`` at the repository top chains five of them.
"""
