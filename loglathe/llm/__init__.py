"""Training-data operators.

Nothing outside this folder, ``corpus_pipeline.py`` and their tests imports it.
"""
