"""Operators for preparing training data, their queries, and the queries' SQL.

Nothing outside this subpackage imports it, apart from the guarded import in
``__spark_entry__.py`` and ``corpus_pipeline.py``.
"""
