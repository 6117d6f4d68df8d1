"""Training-data operators: fingerprints, tokenizing, URL filters, language ID,
near-duplicate search, sharding, mixing and chat formatting.

Nothing outside this subpackage imports it.  ``queries`` holds the registered
queries and their SQL.
"""
