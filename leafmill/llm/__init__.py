"""Operations for training-data pipelines.

Nothing outside this folder (but the top-level ``corpus_pipeline.py`` and the
guarded import in ``__spark_entry__.py``) imports it.
"""
