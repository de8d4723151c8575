"""Training-data operators: filtering, deduplication, mixing, packing and sharding of text corpora.

Nothing outside this subpackage imports it; its queries are in :mod:`talewind.llm.queries`.
"""
