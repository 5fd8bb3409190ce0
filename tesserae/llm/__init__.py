"""Training-data operators: scans, near-duplicate search, tokenizing, packing, archives.

Nothing outside this subpackage imports it.
"""
