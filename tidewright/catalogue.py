"""All registered queries and the SQL that checks them."""

from __future__ import annotations

from .plans import arena, chat, corpus, numbers, sources, tokenizer  # noqa: F401  (each registers its queries)
from .plans.register import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
