"""Operators for preparing text corpora for language-model training.

Each module holds one operator with a general interface; ``queries`` wires them to the driver's tables.
Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
