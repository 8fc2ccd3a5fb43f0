"""Training-data operators: dedup, filtering, scanning, formatting and mixing of text corpora.

Nothing outside this folder imports it.
"""
