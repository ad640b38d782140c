"""Training-data operators: scoring, deduplication, packing, mixing and search over large tables.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
