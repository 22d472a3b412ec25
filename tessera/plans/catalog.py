"""The registered queries of the deck engine and the SQL that checks them."""

from __future__ import annotations

from tessera.plans import deck_queries, decoder_queries, edit_queries, laminate_queries, mesh_queries, source_queries, space_queries  # noqa: F401  they register themselves
from tessera.plans.base import ORACLE, QUERIES

FLAGSHIP = "part_bbox"

__all__ = ["FLAGSHIP", "ORACLE", "QUERIES"]
