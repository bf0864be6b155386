"""Training-data operators: extraction, privacy, archives, decontamination, quality, deduplication and packing.

Nothing outside this package imports it.  Each module holds one operator with its own
general interface; ``queries`` derives the registered digest rows from them.
"""
