"""Training-data operators: filters, deduplication, tokenisation, packing and archives.

Nothing else in the library imports this subpackage; ``llm.queries`` holds the
driver queries and their SQL.
"""
