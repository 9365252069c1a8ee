"""Schemas of the tables that operators give and take."""

from __future__ import annotations

FILES = "path string, rel_path string, ext string, lang string, content string, file_sha256 string, file_ord long"
FUNCTION = "name string, lineno int, source string"
JS_FUNCTION = "name string, lineno int, params array<string>, body_src string"
METHOD = "name string, lineno int, source string, hash string"
CLASS = f"name string, lineno int, bases array<string>, methods array<struct<{METHOD}>>, class_hash string"
NAME_MAP = "array<struct<canon_func string, orig_func string, canon_to_orig map<string,string>>>"
NODE = "node_id string, t string, f_json string"
DOCUMENT = f"root string, sir_sha256 string, source_sha256 string, nodes array<struct<{NODE}>>, name_map {NAME_MAP}"
BLOCK = "name string, lineno int, source string"
