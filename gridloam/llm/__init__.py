"""Training-data operators: tokens, packing, quality, language, dedup, archives, media, search.

Nothing outside this subpackage imports it.
"""
