"""name -> (query, oracle SQL or None), from all operator modules."""

from __future__ import annotations

from blockflow.operators import bits, blockmath, chains, choices, chroma, container, control, decisions, entropy, filters, frames, intra4, media, motion, rate, session

_MODULES = (blockmath, control, bits, frames, filters, chains, entropy, decisions, motion, container, rate, intra4, session, media, chroma, choices)
CATALOG = {name: entry for m in _MODULES for name, entry in m.CATALOG.items()}
QUERIES = {name: query for name, (query, _) in CATALOG.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in CATALOG.items() if sql}
