"""Training-data operators: tokenizing, deduplication, filtering, packing and storage of text corpora.

Nothing outside this subpackage imports it; `queries` holds the registered queries and their SQL.
"""
