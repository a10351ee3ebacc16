"""Sequential operators against small cases, rules against their errors, sources and sinks round trip."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from foliospark.functions import numbering, text
from foliospark.operators import chunks, rules
from foliospark.plans import catalogue
from foliospark.sources import connectors, sinks, structure
from foliospark.streaming import ingest

TINY = "/root/testdata/sf0.001"


def level(*styles):
    table = {"chapter": ("chapter", 0, None), "section": ("section", 1, None)} | {f"d{k}": (f"decimal:{k}", 2, k) for k in range(1, 5)}
    return numbering.levels([None if s is None else table.get(s, (s, 2, None)) for s in styles])


def test_levels():
    assert level("chapter", "section", "paren", "paren", "section", "chapter") == [1, 2, 3, 3, 2, 1]
    assert level("d1", "d2", "d3", "d2", "d1") == [1, 2, 3, 2, 1]
    assert level("circled", "hangul_letter", "circled", None, "hangul_letter") == [1, 2, 1, None, 2]
    assert level("d2", "d3", "paren", "d3") == [1, 2, 3, 2]
    assert level() == []


def test_numbering(spark):
    cases = {"Chapter 3 Scope": "chapter", "第1章 概要": "chapter", "제2절 목적": "section", "제3조": "ko_article", "(2) x": "paren", "1.2 Scope": "decimal:2", "1960 1975": None, "3) x": "num_paren", "① x": "circled", "(a) x": "latin_paren", "가. x": "hangul_letter", "plain": None, "": None, None: None}
    df = spark.createDataFrame(list(cases.items()), "t string, want string").withColumn("got", numbering.classify("t")["style"])
    assert all(r.got == r.want for r in df.collect())


def test_tokens_agree(spark):
    cases = ["", "日本語 ab", "a b c d e", "w " * 15, "w " * 25, "한국어 문장", "a　b\x1cc"]
    df = spark.createDataFrame([(c,) for c in cases], "t string").select("t", text.approx_tokens("t").alias("n"))
    assert all(r.n == chunks.approx_tokens(r.t) for r in df.collect())


def test_pack():
    sentence = "one two three four. "
    nodes = [(1, "heading", "H"), (2, "paragraph", "a b"), (3, "table", "[T]"), (4, "paragraph", sentence * 20), (5, "paragraph", "c"), (6, "paragraph", "")]
    got = chunks.pack(nodes, 20, {"table"})
    assert [(k, at) for k, at, _ in got[:2]] == [("text", [1, 2]), ("table", [3])]
    assert [at for _, at, _ in got].count([4]) == 5 and got[-1][1] == [5, 6] and got[-1][2] == "c"
    assert " ".join(t for _, at, t in got if at == [4]).split() == (sentence * 20).split()
    assert chunks.pack([], 20, set()) == []


def test_chunks_hold_every_node(spark):
    got = catalogue.QUERIES["asm07_chunks"](spark, TINY).collect()
    ids = {(r.document_id, r.chunk_id) for r in got}
    assert len(ids) == len(got)
    for r in got:
        assert r.token_count == chunks.approx_tokens(r.display_text)
        assert r.next is None or (r.document_id, r.next) in ids
    firsts = [r for r in got if r.prev is None]
    assert len(firsts) == len({r.document_id for r in got})


def test_rules(spark):
    df = spark.createDataFrame([(1, "Contents", 0.5), (2, None, None), (3, "1.1 Scope", 0.1)], "id int, text string, page_frac double")
    cases = [({"text_matches": "^contents$"}, []), ({"text_matches": {"pattern": "^contents$", "flags": "i"}}, [1]), ({"page_frac": {"gte": 0.4}}, [1]), ({"page_frac": {"not_in": [0.5]}}, [2, 3]), ({"not": {"page_frac": {"not_null": True}}}, [2]), ({"classify_numbering": True}, [3]), ({"any": [{"page_frac": {"lt": 0.2}}, {"page_frac": 0.5}]}, [1, 3]), ({}, [1, 2, 3])]
    for clause, want in cases:
        assert sorted(r.id for r in df.where(rules.predicate(clause)).collect()) == want, clause
    for bad in ({"colour": 1}, {"page_frac": {"like": 1}}):
        with pytest.raises(ValueError):
            rules.predicate(bad)


def test_zones_carry(spark):
    d = "document_id string, page_index int, ord long, para_id long, own_zone string, opens_zone boolean"
    rows = [("a", 0, 1, 1, None, False), ("a", 0, 2, 2, "references", True), ("a", 1, 1, 3, None, False), ("a", 1, 2, 4, "furniture", False), ("a", 1, 3, 5, None, False), ("b", 0, 1, 6, None, False)]
    got = {r.para_id: r.zone for r in rules.carried(spark.createDataFrame(rows, d)).collect()}
    assert got == {1: "body", 2: "references", 3: "references", 4: "furniture", 5: "references", 6: "body"}


def test_structure(spark):
    tree = {"kids": [{"type": "heading", "content": "A", "page number": 1, "heading level": 1, "font size": 12, "bounding box": [0, 1, 2, 3]}, {"type": "list", "list items": [{"type": "list item", "content": "x", "colour": "red"}]}, 7]}
    df = spark.createDataFrame([("d", json.dumps(tree)), ("e", None), ("f", "{broken"), ("g", "")], "document_id string, structure string")
    got = sorted(structure.nodes(df).collect(), key=lambda r: r.ord)
    assert [(r.document_id, r.kind, r.parent, r.text) for r in got] == [("d", "heading", 0, "A"), ("d", "list", 0, None), ("d", "list item", 2, "x")]
    assert got[0].bbox == [0, 1, 2, 3] and json.loads(got[2].extra) == {"colour": "red"}


def test_connectors(spark):
    df = spark.createDataFrame([("d", i, bytearray(b"x" * i)) for i in range(5)], "document_id string, page_index int, payload binary")
    ok = connectors.call(df, lambda rs: [connectors.Reply(text=str(len(r.payload))) for r in rs], 2).collect()
    assert sorted((r.page_index, r.text) for r in ok) == [(i, str(i)) for i in range(5)]
    bad = connectors.call(df, lambda rs: [], 2).collect()
    assert len(bad) == 5 and all(r.text is None and "replies" in r.error for r in bad)


def test_sinks(spark, tmp_path):
    df = sinks.tagged(spark.createDataFrame([("a", 1, None), ("b", 2, "x")], "k string, n int, t string"), "chunk")
    sinks.write_jsonl(df, f"{tmp_path}/j", "k")
    assert sorted(json.loads(x)["n"] for p in (tmp_path / "j").rglob("*.json") for x in p.read_text().splitlines()) == [1, 2]
    sinks.write_table(df, f"{tmp_path}/t", "k")
    sinks.write_table(df.where("k = 'a'").withColumn("n", F.lit(9)), f"{tmp_path}/t", "k", mode="overwrite")
    assert sorted(r.n for r in spark.read.parquet(f"{tmp_path}/t").collect()) == [2, 9]
    schema = StructType.fromDDL("k string, absent double")
    assert sinks.conform(df, schema, "chunk").columns == ["k", "absent"]
    with pytest.raises(Exception, match="contract"):
        sinks.conform(df.withColumn("contract_version", F.lit("9.0")), schema, "chunk").collect()


def test_stream_equals_batch(spark, tmp_path):
    src = spark.read.parquet(f"{TINY}/page_outcomes.parquet").select("out_id", "ingested_at", "route", "markdown")
    src.repartition(3).write.parquet(f"{tmp_path}/in")
    q = ingest.write_once(ingest.arriving(spark, f"{tmp_path}/in", src.schema, "900 days"), f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.count() == src.select("out_id").distinct().count()
    assert sum(r.pages for r in ingest.windows(got, "1 day", "route").collect()) == got.count()
