"""Training-data operators: packing, dedup, language ID, search, media, WARC, BPE, sharding, filters.

Nothing outside this subpackage imports it; it can be deleted as a whole.
"""
