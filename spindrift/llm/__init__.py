"""Training-data operators: deduplication, sharding, token files, scans, filters, packing and language ID.

Nothing outside this subpackage imports it.
"""
