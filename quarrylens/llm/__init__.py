"""Training-data operators: packing, BPE, fingerprints, near duplicates,
quality, URL and licence filters, line dedup and token files.

Nothing outside this subpackage imports it.
"""
