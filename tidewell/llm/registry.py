"""The subpackage's queries and SQL."""

from __future__ import annotations

from tidewell.llm import bpe, divergence, embeddings, lines, lm, packing, quality, secrets, simhash, substrings, suffixes, urls, whitening

MODULES = (simhash, bpe, substrings, suffixes, lines, embeddings, packing, lm, quality, secrets, whitening, divergence, urls)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}
