"""Registered queries of the library and the SQL that states the same results."""

from __future__ import annotations

from codicil.plans import catalog_amendments, catalog_answers, catalog_assembly, catalog_batches, catalog_checks, catalog_core, catalog_hybrid, catalog_match, catalog_phrases, catalog_search, catalog_structure, catalog_text, catalog_titles, catalog_versions, catalog_work

CATALOGS = (catalog_core, catalog_search, catalog_checks, catalog_work, catalog_answers, catalog_structure, catalog_match, catalog_text, catalog_versions, catalog_hybrid, catalog_amendments, catalog_titles, catalog_phrases, catalog_batches, catalog_assembly)

QUERIES = {name: build for c in CATALOGS for name, build in c.QUERIES.items()}
SQL = {name: sql for c in CATALOGS for name, sql in c.SQL.items()}
FLAGSHIP = "keyword_lane"
