"""Injected connectors: work outside the engine (rendering, recognition, models) behind one typed call a batch.

A connector maps a list of requests to as many replies, in order. An error of one request is a reply with `error`, so one
page never fails a job; an error of the call itself gives every request of the batch that reply.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame


@dataclass(slots=True)
class Request:
    document_id: str | None
    page_index: int | None
    payload: bytes | None


@dataclass(slots=True)
class Reply:
    text: str | None = None
    error: str | None = None


Connector = Callable[[list[Request]], list[Reply]]
REPLIES = "document_id string, page_index int, text string, error string"


def call(df: DataFrame, connector: Connector, batch: int = 32) -> DataFrame:
    """Replies to rows of (document_id, page_index, payload), `batch` requests a call; the connector runs on the executors."""

    def run(batches):
        for b in batches:
            rows = [Request(*r) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            replies: list[Reply] = []
            for i in range(0, len(rows), batch):
                part = rows[i : i + batch]
                try:
                    got = list(connector(part))
                    if len(got) != len(part):
                        raise ValueError(f"{len(got)} replies to {len(part)} requests")
                except Exception as e:  # noqa: BLE001
                    got = [Reply(error=f"{type(e).__name__}: {e}") for _ in part]
                replies += got
            yield pa.RecordBatch.from_arrays(
                [pa.array([r.document_id for r in rows], pa.string()), pa.array([r.page_index for r in rows], pa.int32()), pa.array([r.text for r in replies], pa.string()), pa.array([r.error for r in replies], pa.string())],
                names=["document_id", "page_index", "text", "error"],
            )

    return df.select("document_id", "page_index", "payload").mapInArrow(run, REPLIES)
