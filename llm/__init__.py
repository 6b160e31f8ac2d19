"""Operators for preparing language-model training data on Spark.

Nothing outside this package (and ``corpus_pipeline.py``) imports it.
"""
