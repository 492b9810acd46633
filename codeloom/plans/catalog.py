"""Queries of the engine's own operators over the test tables, and DuckDB SQL that gives the same rows."""

from __future__ import annotations

from codeloom.plans import catalog_links, catalog_more, catalog_rest, catalog_state, catalog_symbols, catalog_text

QUERIES: dict = catalog_text.Q | catalog_symbols.Q | catalog_state.Q | catalog_more.Q | catalog_links.Q | catalog_rest.Q
SQL: dict[str, str] = catalog_text.S | catalog_symbols.S | catalog_state.S | catalog_more.S | catalog_links.S | catalog_rest.S
