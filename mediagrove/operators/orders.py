"""The orders in which documents list their rows.

Operators give rows in no order: a total order costs a range shuffle of whole rows, and only the document that is written needs it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

ORDERS = {
    "proposals": ["canonical_id", "root_id", "path"],
    "unmapped": ["root_id", "path"],
    "import plan": ["destination_root", "destination_path", "source_root", "source_path"],
    "export plan": ["profile", "destination_path", "source_path"],
    "bundle plan": ["profile", "destination_path", "source_path"],
    "files": ["path"],
    "history": ["type", "id"],
    "observations": ["root_id", "path"],
    "games": ["platform_name", "title", "game"],
    "platforms": ["platform_name", "platform"],
    "candidates": ["name", "id"],
    "sources": ["name", "id"],
    "devices": ["id"],
    "diagnostics": ["source", "status", "message"],
}


def in_order(rows: DataFrame, document: str) -> DataFrame:
    return rows.orderBy(*ORDERS[document])
