"""Queries and SQL of all modules of the subpackage."""

from tarnlight.llm import bpe, chats, fingerprints, language, near_duplicates, packing, pii, search, substrings, warc

MODULES = [fingerprints, pii, search, substrings, warc, language, near_duplicates, chats, packing, bpe]
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}
