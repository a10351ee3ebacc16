"""Stitched chunks against whole texts, and exact round trips."""

import random

import pyarrow.parquet as pq
import pytest

from foliospark.llm import encoding

R = random.Random(4)
ODD = ["", " ", "x" * 3000, " " * 3000, "\n\n  \n" * 500, "日本語" * 900, "7" * 2500, "it's we'll  they've 12 <|endoftext|>\t" * 60, "".join(R.choice("ab 1.'\n\t日é’😀") for _ in range(5000)), "a" * 900 + " " + "b" * 1500 + "  c" * 300, "﻿​é" * 400]


def whole(text):
    return encoding._tokenizer().encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("size", [7, 64, 500])
@pytest.mark.parametrize("k", range(len(ODD)))
def test_ids_are_those_of_the_whole(k, size):
    offsets, ids = encoding.encode([ODD[k]], size)
    assert ids.tolist() == whole(ODD[k]) and offsets.tolist() == [0, len(ids)]


def test_long_texts_are_cut():
    text = "The tank was moved, and it wasn't full. " * 3000
    assert len(list(encoding.chunks(text))) >= 6
    assert "".join(encoding.chunks(text)) == text


def test_round_trip_of_documents():
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist()
    offsets, ids = encoding.encode(texts, 2000)
    for t, a, b in zip(texts, offsets[:-1], offsets[1:], strict=True):
        assert encoding.decode(ids[a:b].tolist()) == (t or "")
        if t and len(t) > 2000:
            assert ids[a:b].tolist() == whole(t)
