"""Sizes, pieces and ids."""

import base64

import pyarrow.parquet as pq
import pytest

import __spark_entry__ as e
from foliospark.llm import encoding, pieces

TINY = "/root/testdata/sf0.001"


def table(name):
    return pq.read_table(f"{TINY}/{name}.parquet").to_pylist()


def reference_size(text):
    cjk = [c for c in text if "぀" <= c <= "ヿ" or "㐀" <= c <= "鿿" or "가" <= c <= "힣"]
    return len(cjk) + round(1.3 * len("".join(" " if c in set(cjk) else c for c in text).split()))


def test_size():
    assert [pieces.size(x) for x in ("日本語日本", "three latin words", "", "a　b c\x1cd", "ab語cd")] == [5, 4, 0, 5, 4]


def test_found_is_size_over_profile(spark):
    child = {r["profile_id"]: r["child_tokens"] for r in table("chunk_policy")}
    profile = {r["document_id"]: r["profile_id"] or "default" for r in table("docmeta")}
    want = {r["para_id"] for r in table("odl_paragraphs") if r["text"] and reference_size(r["text"]) > child[profile.get(r["document_id"], "default")]}
    got = [r.para_id for r in e.queries()["p3_found"](spark, TINY).collect()]
    assert want and sorted(got) == sorted(want)


def test_size_column_is_size(spark):
    texts = ["", " \n", "日本語 ab", "a　b c\x1cd\x85e", "😀x 语", "w " * 15, "w " * 25, "ไทย ไทย"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", pieces.size_col(pieces.F.col("t")).alias("n")).collect()
    assert [r.n for r in sorted(got)] == [pieces.size(t) for t in texts] == [reference_size(t) for t in texts]


@pytest.mark.parametrize("text", ["One two three four. " * 90, "日本語の文です。" * 60, "w " * 700, "x" * 5000, "日本" * 300 + " tail words here"])
@pytest.mark.parametrize("most,overlap", [(64, 8), (96, 0), (10, 9)])
def test_pieces_cover_in_order_under_the_size(text, most, overlap):
    ends = [i + 1 for i, c in enumerate(text) if c in ".。"]
    got = pieces.cut(text, most, overlap, ends)
    assert got[0][0] == 0 and got[-1][1] == len(text.rstrip())
    for s, x in got:
        assert 0 < pieces.size(text[s:x]) <= most
    for (s, x), (s2, x2) in zip(got, got[1:]):
        assert s < s2 and x < x2 and not text[x:s2].strip() and pieces.size(text[s2:x]) <= overlap
    if text.startswith("One") and most == 64:
        assert all(x in ends for _, x in got)
        assert all(pieces.size(text[b:a]) >= overlap - 1 for (_, a), (b, _) in zip(got, got[1:]))


@pytest.mark.parametrize("text", ["w " * 100, "日本" * 130, "One two three four. " * 31])
@pytest.mark.parametrize("overlap", [0, 8])
def test_pieces_are_of_even_size(text, overlap):
    sizes = [pieces.size(text[s:x]) for s, x in pieces.cut(text, 64, overlap, [i + 1 for i, c in enumerate(text) if c == "."])]
    assert len(sizes) > 2 and max(sizes) - min(sizes) <= max(overlap + 3, 6)


def test_cuts_are_the_cheapest():
    import itertools
    import random

    r = random.Random(2)
    for _ in range(40):
        text = "".join(r.choice(("ab ", "ab, ", "ab. ", "日", "本。", "語、")) for _ in range(11)).rstrip()
        ends = [i + 1 for i, c in enumerate(text) if c in ".。"]
        spans = [m.span() for m in pieces._ATOM.finditer(text)]
        n, most = len(spans), 5

        def price(cuts):
            total, at = 0.0, [0, *cuts, n]
            for a, b in zip(at, at[1:]):
                piece = text[spans[a][0] : spans[b - 1][1]]
                if pieces.size(piece) > most:
                    return float("inf")
                counted = len(pieces._COUNTED.findall(piece))
                total += pieces.PIECE + pieces.EVEN * ((counted + 1.3 * (b - a - counted)) / most) ** 2
                if b < n:
                    stop, gap = spans[b - 1][1], text[spans[b - 1][1] : spans[b][0]]
                    total += 0.0 if stop in ends else pieces.CLAUSE if text[stop - 1] in ",、" else pieces.WORD if gap else pieces.INSIDE
            return total

        stops = [b for _, b in spans]
        got = price([stops.index(x) + 1 for _, x in pieces.cut(text, most, 0, ends)][:-1])
        assert abs(got - min(price(c) for k in range(n) for c in itertools.combinations(range(1, n), k))) < 1e-9


def test_all_pieces_of_the_tables(spark):
    df = e.queries()["p3_pieces"](spark, TINY).collect()
    found = {r.para_id for r in e.queries()["p3_found"](spark, TINY).collect()}
    assert {r.para_id for r in df} == found and all(sum(r.para_id == i for r in df) > 1 for i in found)


def test_ids_are_those_of_the_other_library(spark):
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = e.queries()["p7_ids"](spark, TINY).collect()
    text = {r["doc_id"]: r["text"] for r in table("documents")}
    assert len(got) == len(text)
    for r in got:
        assert r.ids == other.encode_ordinary(text[r.doc_id] or ""), r.doc_id


def test_chunks_do_not_change_ids():
    texts = ["a  b\n\n c's 12 <|endoftext|> 日本語  x \t\n" * 9, None, "", " ", "x" * 50]
    whole, parts = encoding.encode(texts), encoding.encode(texts, 3)
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))
    assert list(whole[0])[1:4] == [whole[0][1]] * 3
