"""Logical tables of the package model, as DDL; readers declare them instead of inferring."""

from __future__ import annotations

SCHEMAS = {
    "entries": "package_id string, seq int, name string, compression string, crc32 long, csize long, usize long, offset long, payload binary, error string",
    "content_types": "package_id string, kind string, key string, content_type string, ord int",
    "parts": "package_id string, part_id int, name string, content_type string, orphaned boolean",
    "relationships": "package_id string, source_id int, rel_id string, type string, target_kind string, target_id int, target_text string",
    "tokens": "package_id string, part string, seq int, kind string, name string, attrs map<string,string>, start int, end int, depth int",
    "bindings": "package_id string, id string, kind string, source string, part string, shape_id int, action string",
    "table_rows": "table_id string, row_no int, fields map<string,string>",
    "chart_data": "chart_id string, category_no int, category string, series_no int, series string, value double",
    "deltas": "session_id long, seq long, expected_revision long, next_revision long, key string, value string, ts timestamp",
    "nodes": "deck_id string, node_id string, parent_id string, ord int, role string, kind string, text string",
    "fragments": "deck_id string, page_no int, region_id string, node_id string, slice_kind string, start int, end int",
    "diagnostics": "code string, severity string, part string, node_id string, message string",
}
