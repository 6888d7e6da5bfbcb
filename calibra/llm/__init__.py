"""Training-data operators: deduplication, decontamination, tokenisation, scoring.

Nothing outside this subpackage (but corpus_pipeline.py) imports it.
"""
