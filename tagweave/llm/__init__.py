"""Operators for large training-data pipelines.

Nothing outside this subpackage imports it; see ``queries.py`` for the
registered queries and ``../../corpus_pipeline.py`` for the staged pipeline.
"""
