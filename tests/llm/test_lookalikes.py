"""Forms, and pairs against brute force."""

import itertools

import pyarrow.parquet as pq
import pytest

from foliospark.llm import lookalikes
from foliospark.llm.lookalikes import canonical, readable
from foliospark.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize(
    "a,b", [("Ｔａｂｌｅ １", "Table 1"), ("е́t", "ét"), ("Тable", "Table"), ("na​me", "name"), ("a b", "a b"), ("ﬁrst", "first"), ("ё", "ë"), ("Ά", "Á"), ("co‑op", "co-op"), ("a\x0cb", "a\nb"), ("a\x0cb c", "a\nb c"), ("é", "é")]
)
def test_equal_forms(a, b):
    assert canonical(a) == canonical(b)


@pytest.mark.parametrize("a,b", [("l", "1"), ("I", "l"), ("O", "0"), ("A", "a"), ("a b", "a  b"), ("a\nb", "a b"), ("Table 1", "Table 2"), ("’", "'")])
def test_different_forms(a, b):
    assert canonical(a) != canonical(b)


def test_idempotent_and_readable():
    for c in map(chr, [*range(0x20, 0xD800), *range(0xE000, 0x20000)]):
        assert canonical(canonical(c)) == canonical(c)
    assert readable("таблица 1") == "таблица 1"


def test_pairs_against_brute_force(spark):
    got = {tuple(r) for r in QUERIES["p2_found"](spark, SF).collect()}
    want = set()
    for rec, i, c in lookalikes.RECORDS:
        groups = {}
        for r in pq.read_table(f"{SF}/{rec}.parquet", columns=[i, "document_id", c]).to_pylist():
            if r["document_id"] is not None and r[c] and r[c].strip():
                groups.setdefault((r["document_id"], canonical(r[c])), set()).add((r[i], r[c]))
        for g in groups.values():
            want |= {(rec, min(x, y), max(x, y)) for (x, a), (y, b) in itertools.combinations(g, 2) if a != b and x != y}
    assert got == want and want


def test_hot_group_and_clashes(spark, monkeypatch):
    monkeypatch.setattr(lookalikes, "HOT", 10)
    rows = [("r", "d", i, "a" if i % 3 else "а", "a") for i in range(60)]
    df = spark.createDataFrame(rows, "rec string, document_id string, id bigint, text string, form string")
    got = {(r.id_a, r.id_b) for r in lookalikes._unlike(df).collect()}
    assert got == {(i, j) for i in range(60) for j in range(i + 1, 60) if (i % 3 == 0) != (j % 3 == 0)}
    with pytest.raises(ValueError):
        lookalikes.with_form(df, "text", "form")
