"""Training-data operators: decontamination, language, URL, WARC, near-duplicate,
HTML, embedding, token file, quality and packing operators.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
