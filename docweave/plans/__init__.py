"""Queries over the driver tables, by family."""

from __future__ import annotations

import importlib

MODULES = ("tables_and_joins", "aggregates_and_windows", "graph_and_revisions", "text_and_geometry", "model_checks", "patches_and_flow", "shapes_and_decks", "xml_and_layouts", "checks_and_limits", "sources_and_streams")


def load() -> None:
    """Register all queries."""
    for module in MODULES:
        importlib.import_module(f"{__name__}.{module}")
