"""SQL for texts made from templates, in which ~x~ stands for a column."""

from __future__ import annotations


def text_sql(template: str, columns: dict[str, str]) -> str:
    """SQL expression of a template."""
    pieces = template.split("~")
    parts = [columns[p] if i % 2 else "'" + p.replace("'", "''") + "'" for i, p in enumerate(pieces)]
    return " || ".join(p for p in parts if p != "''") or "''"


def block_sql(source: str, columns: dict[str, str], blocks: list[tuple[str, tuple[str, int, str] | None]]) -> str:
    """(key, name, lineno, source_sha256) of the blocks that rows get in turn by key."""
    key = columns["k"]
    return "\nUNION ALL ".join(
        f"SELECT {key}, {text_sql(found[0], columns)} AS name, {found[1]} AS lineno, sha256({text_sql(found[2], columns)}) AS source_sha256 FROM {source} WHERE {key} % {len(blocks)} = {i}"
        for i, (_, found) in enumerate(blocks)
        if found
    )
