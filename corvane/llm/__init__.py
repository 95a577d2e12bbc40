"""Operators for preparing language-model training data.

Each module holds one operator.  Nothing outside this folder (and the top-level
``corpus_pipeline.py``) imports it, so it can be removed as a whole.
"""
