"""Training-data operators: quality, archives, search, deduplication, tokens, sharding, secrets, mixing.

Nothing outside this package imports it; the entry module adds its queries only
when the package is present.
"""
