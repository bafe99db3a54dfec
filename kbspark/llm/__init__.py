"""Training-data operators: URL rules, near-duplicates, tokenizing, search, scoring, packing.

Nothing outside this subpackage imports it (``__spark_entry__`` adds its queries if present).
"""
