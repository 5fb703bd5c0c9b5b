"""Training-data operators: near-dedup, extraction, tokenising, packing, search.

Nothing outside this subpackage imports it, and deleting it leaves the rest whole.
"""
