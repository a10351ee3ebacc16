"""Problem 7: texts as byte_bpe_50k ids without special tokens.

A long text is cut into chunks that overlap, each pre-tokenised on its own. Two neighbours are stitched at the first place in
their overlap where a pre-token of both begins: the vocabulary's pattern reads on from a beginning without looking back, so
from there both agree, and what lies before it holds up to the chunk's last pre-token, which its end may have cut. The
pieces between the stitches are encoded by themselves and their ids joined. Where an overlap has no such place (one
pre-token of any length), the chunk is read on in steps that double until there is one. Distinct texts of a batch are
encoded once. Decoding joins the bytes of the ids, so it gives the text back exactly.

Defined results: null and empty texts give an empty list; the strings of special tokens are ordinary text.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import TOKENIZER_DIR, arrow_map, read, spread

VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
CHUNK = 16_384  #: characters a chunk begins after the one before
OVERLAP = 256  #: characters it goes on into the next
GROUP = 262_144  #: characters that are encoded at once, about


@cache
def _tokenizer():
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    t = Tokenizer.from_file(f"{TOKENIZER_DIR}/{VOCABULARY}")
    t.encode_special_tokens = True
    return t


def _begins(text: str, a: int, b: int) -> list[int]:
    """Where pre-tokens begin in text[a:b], read from a."""
    return [a + at[0] for _, at in _tokenizer().pre_tokenizer.pre_tokenize_str(text[a:b])]


def stitches(text: str, size: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """Places, the first 0, at which the text may be cut without changing its ids."""
    n = len(text)
    starts = range(0, n, size)
    read = [_begins(text, s, min(n, s + size + overlap)) for s in starts]  # each by itself
    out, k = [0], 0
    while k + 1 < len(starts):
        own, ends, j, step = read[k], min(n, starts[k] + size + overlap), k + 1, 1
        while True:
            # beginnings that hold: all of the chunk's own but its last one, whose pre-token its end may have
            # cut; and not after white space, whose pre-tokens look ahead
            held = [b for b in own[: None if ends == n else -1] if b >= starts[j] and not text[b - 1].isspace()]
            at = min(set(held).intersection(read[j]), default=None)
            if at is not None and at > out[-1]:
                out.append(at)
                k = j
                break
            if ends == n:
                return out
            j = min(len(starts) - 1, j + step)
            step *= 2
            ends = n if j == len(starts) - 1 else min(n, starts[j] + overlap)
            own = _begins(text, out[-1], ends)
    return out


def chunks(text: str, least: int = CHUNK) -> Iterator[str]:
    """The text in pieces whose ids are independent, of about `least` characters."""
    if len(text) <= least:
        yield text
        return
    at = stitches(text, least, max(1, min(OVERLAP, least)))
    for a, b in zip(at, [*at[1:], len(text)], strict=True):
        yield text[a:b]


def encode(texts: list[str | None], least: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, ids) of the texts, as of a list array."""
    t, ids, lengths, group, held = _tokenizer(), [], np.zeros(len(texts), np.int64), [], 0

    def flush():
        for (i, _), e in zip(group, t.encode_batch([c for _, c in group], add_special_tokens=False), strict=True):
            ids.append(np.array(e.ids, np.int32))
            lengths[i] += len(ids[-1])
        group.clear()

    for i, text in enumerate(texts):
        for c in chunks(text or "", least):
            group.append((i, c))
            held += len(c)
            if held >= GROUP:
                flush()
                held = 0
    flush()
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32), np.concatenate(ids) if ids else np.empty(0, np.int32)


def decode(ids: list[int]) -> str:
    """The text of ids, by their bytes."""
    table = _bytes()
    return b"".join(table[i] for i in ids).decode("utf-8")


@cache
def _bytes() -> list[bytes]:
    import base64

    with open(f"{TOKENIZER_DIR}/{RANKS}", "rb") as f:
        ranks = {int(n): base64.b64decode(b) for b, n in (line.split() for line in f if line.strip())}
    return [ranks.get(i, b"") for i in range(max(ranks) + 1)]


def encode_ids(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids) of each row."""

    def run(b: pa.RecordBatch) -> dict:
        d = pc.dictionary_encode(b.column(1), null_encoding="encode")
        offsets, ids = encode(d.dictionary.to_pylist())
        return {id_col: b.column(0), "ids": pa.ListArray.from_arrays(offsets, ids).cast(pa.list_(pa.int32())).take(d.indices)}

    return arrow_map(df.select(id_col, text_col), run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, ids array<int>")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of each document's text; doc_id is unique."""
    return encode_ids(spread(read(spark, sf_dir, "documents", "doc_id", "text")))
