"""Every query of the library outside the package llm, and its SQL."""

from __future__ import annotations

from foliolake.plans import q_chapters, q_charmap, q_layout, q_scalars, q_sources, q_stats, q_text, q_trees  # noqa: F401
from foliolake.plans.registry import QUERIES, SQL  # noqa: F401
