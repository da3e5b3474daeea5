"""The queries of this subpackage and their SQL, for ``__spark_entry__``."""

from shelfmark.llm import bpe, conversations, divergence, jaccard, language, lines, media, mixing, neighbours, quality, secrets, sharding, tokenfile

_MODULES = (sharding, language, secrets, quality, bpe, media, jaccard, lines, mixing, tokenfile, neighbours, conversations, divergence)

QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
