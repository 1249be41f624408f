"""Training-data operators: mixing, deduplication, ranking, screening and packing of text corpora.

Nothing outside this folder imports it.
"""
