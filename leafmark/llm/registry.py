"""The queries of the corpus operators and the SQL that states the same result, where SQL can."""

from __future__ import annotations

from leafmark.llm import codes, decontaminate, fim, interpolation, langid, media, neardup, packing, quality, repeats, secrets, topk, warc

_MODULES = (warc, neardup, secrets, interpolation, langid, media, quality, packing, decontaminate, repeats, fim, topk, codes)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in _MODULES for k, s in m.ORACLES.items()}
