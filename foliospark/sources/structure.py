"""Structure JSON to typed rows: the tree of an extractor's output, flattened in document order."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame

NODES = "document_id string, ord bigint, parent bigint, page bigint, kind string, id string, text string, heading_level int, font_size double, bbox array<double>, extra string"
_KNOWN = {"type", "id", "page number", "content", "heading level", "font size", "bounding box", "kids", "list items", "rows", "cells"}


def flatten(tree: dict | list) -> list[dict]:
    """Nodes of a structure tree, parents before children; ord counts from 1, parent is 0 at the top.

    Keys that aren't known are kept as JSON in `extra`; a value of the wrong kind gives null."""
    out: list[dict] = []
    todo: list[tuple[object, int, int | None]] = [(tree, 0, None)]
    while todo:
        node, parent, page = todo.pop()
        if isinstance(node, list):
            todo += [(x, parent, page) for x in reversed(node)]
            continue
        if not isinstance(node, dict):
            continue
        own = node.get("page number", page)
        own = own if isinstance(own, int) and not isinstance(own, bool) else page
        here = parent
        if "type" in node or "content" in node:
            box, size, level = node.get("bounding box"), node.get("font size"), node.get("heading level")
            number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
            rest = {k: v for k, v in node.items() if k not in _KNOWN}
            out.append(
                {
                    "ord": len(out) + 1, "parent": parent, "page": own, "kind": node.get("type") if isinstance(node.get("type"), str) else None,
                    "id": None if node.get("id") is None else str(node["id"]), "text": node.get("content") if isinstance(node.get("content"), str) else None,
                    "heading_level": level if isinstance(level, int) and not isinstance(level, bool) else None, "font_size": float(size) if number(size) else None,
                    "bbox": [float(x) for x in box[:4]] if isinstance(box, list) and len(box) >= 4 and all(map(number, box[:4])) else None,
                    "extra": json.dumps(rest, ensure_ascii=False, sort_keys=True) if rest else None,
                }
            )
            here = len(out)
        todo += [(node[k], here, own) for k in ("cells", "rows", "list items", "kids") if k in node]
    return out


def nodes(df: DataFrame, id_col: str = "document_id", json_col: str = "structure") -> DataFrame:
    """Rows of NODES from one structure JSON a row. Null, empty and broken JSON give no node."""

    def run(batches):
        for b in batches:
            rows: list[dict] = []
            for i, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    tree = json.loads(s) if s else []
                except ValueError:
                    tree = []
                rows += [{"document_id": i} | n for n in flatten(tree)]
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return df.selectExpr(f"CAST(`{id_col}` AS STRING) AS document_id", f"`{json_col}` AS structure").mapInArrow(run, NODES)


_ARROW = pa.schema(
    [("document_id", pa.string()), ("ord", pa.int64()), ("parent", pa.int64()), ("page", pa.int64()), ("kind", pa.string()), ("id", pa.string()), ("text", pa.string()), ("heading_level", pa.int32()), ("font_size", pa.float64()), ("bbox", pa.list_(pa.float64())), ("extra", pa.string())]
)
