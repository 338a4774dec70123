"""The queries of this subpackage and the SQL that some can be checked against."""

from __future__ import annotations

from walkframe.llm import bpe, divergence, exact, html, lexical, mixing, pii, quality, simhash, substrings, toxicity, vectors

MODULES = (html, substrings, mixing, pii, toxicity, bpe, quality, vectors, simhash, divergence, lexical, exact)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
