"""Cut texts: held-out cuts, limits, edges."""

import random

import pytest

from foliospark.llm import cuts
from foliospark.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def halves(spark):
    rows = [(r.text, None, "no") for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").where("length(text) > 60").orderBy("doc_id").collect()]
    return cuts.train(rows[::2]), rows[1::2]


def test_precision_and_recall_on_held_out_cuts(halves):
    model, rows = halves
    r = random.Random(5)
    good = [t for t, d, a in rows if cuts.intact(t, d, a, model.words)]
    bad = [c for t in good if not cuts._WHOLE.search(c := cuts.cut_at_random(r, t)) and cuts.end_line(c)[0] == "text"]
    found = sum(model.score(t, len(t), "no") >= 0.5 for t in bad)
    false = sum(model.score(t, len(t), "no") >= 0.5 for t in good)
    assert found / len(bad) >= 0.9
    assert false / len(good) <= 0.03


def test_edges(halves):
    model, _ = halves
    for whole in ("…", "12", "A short note."):
        assert model.score(whole, None, "no") < 0.5
    assert model.score("Everything was moved to the upper flo", None, "no") >= 0.5
    assert model.score("Everything was moved.", None, "chars") >= 0.5


def test_limits(spark):
    rows = [("a", f"{i:03d}" + "x" * 97) for i in range(30)] + [("a", "y" * i) for i in range(1, 90)] + [("b", "z" * (70 + 3 * i)) for i in range(40)] + [(None, "n" * 100)] * 9 + [("a", None), ("a", "")]
    got = cuts.limits(spark.createDataFrame(rows, "source string, text string")).collect()
    assert [(r.source, r.unit, r.most) for r in got] == [("a", "chars", 100)]


def test_rates_add_up(spark):
    rates = QUERIES["p9_rates"](spark, SF).collect()
    assert sum(r.cut for r in rates) == QUERIES["p9_found"](spark, SF).count()
    assert sum(r.texts for r in rates) == 1000


def test_announcements_are_no_cuts(halves):
    model, _ = halves
    for note in ("\n\nTo be continued ...", "\nTo be continued…", " To be continued."):
        t = "The field manual was compared with the spare valves. Everything was moved." + note
        assert model.score(t, len(t), "no") < 0.5 and model.score(t, len(t), "chars") < 0.5
        assert model.score(t.replace("moved.", "moved to the upper flo\n"), None, "no") >= 0.5


def test_a_limit_does_not_cut_what_is_closed_beyond_chance(halves):
    model, rows = halves
    r = random.Random(3)
    good = [t for t, _, _ in rows if cuts._WHOLE.search(t) and len(t) > 200]
    held, taught = good[::4], [t for i, t in enumerate(good) if i % 4]
    bare = [(t[: r.randint(100, len(t) - 1)], None, "chars") for t in taught]
    plain = [(t, None, "no") for t in taught]
    closed = [(t, None, "chars") for t in taught[::3]]
    mixed = cuts.train(plain + bare + closed)
    assert cuts.chance(plain + bare + closed, plain, "chars", mixed.words, r) < 0.5 < cuts.chance(plain + bare, plain, "chars", mixed.words, r)
    assert sum(mixed.score(t, None, "chars") >= 0.5 for t in held) <= 0.1 * len(held)
    inside = [t[:150] for t in held if not cuts.closed(t[:150], mixed.words)]
    assert sum(mixed.score(t, None, "chars") >= 0.5 for t in inside) >= 0.9 * len(inside)


def test_thai_without_end_marks(spark):
    rows = [(r.text, None, "no") for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").where("length(text) between 60 and 20000 and doc_id % 3 = 0").orderBy("doc_id").collect()]
    model, before = cuts.train(rows), "สำเนาที่เก็บไว้อธิบายแถวของตารางหลังการทบทวนครั้งที่สอง "
    for whole in ("คู่มือภาคสนามอธิบายบ่อน้ำด้านล่างในเขตตะวันออก", "ถังเก็บน้ำอธิบายบ่อน้ำด้านล่างภายใต้ภาระปกติ", "ค่าเพิ่มขึ้นจาก 9.0 เป็น 15.5 (ดูรูปที่ 36.3)"):
        assert model.score(before + whole, None, "no") < 0.5
    assert model.score(before + "คู่มือภาคสนามอธิบายบ่อน้ำด้", None, "no") >= 0.5
