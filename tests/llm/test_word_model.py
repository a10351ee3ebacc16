"""The word model counts every paragraph, whatever the order and the size of the file."""

import pyarrow as pa
import pyarrow.parquet as pq

from foliospark.llm import sentences

FILLER = ["Seals of the valve were inspected twice. The results are listed below in full."] * 13_000
LATE = ["This was shown by the Qzx. Harrow group in the same year and repeated by them later."] * 400


def model(spark, folder, texts):
    folder.mkdir()
    pq.write_table(pa.table({"kind": ["paragraph"] * len(texts), "text": texts}), folder / "odl_paragraphs.parquet")
    return sentences.fitted(spark, str(folder))


def test_words_of_late_rows_are_learned(spark, tmp_path):
    m = model(spark, tmp_path / "a", FILLER + LATE)
    assert m.closes["qzx"] < -2
    assert m == model(spark, tmp_path / "b", LATE + FILLER) == sentences.fit(FILLER + LATE)


def test_model_of_tables_is_fit_of_all_rows(spark):
    rows = pq.read_table("/root/testdata/sf0.01/odl_paragraphs.parquet", columns=["kind", "text"]).to_pylist()
    texts = [r["text"] for r in rows if r["kind"] in ("paragraph", "text block", "list item") and r["text"] and len(r["text"]) > 40]
    m = sentences.fitted(spark, "/root/testdata/sf0.01")
    assert m.opens and m.closes and m == sentences.fit(texts)


def test_no_paragraphs_give_an_empty_model(spark, tmp_path):
    assert model(spark, tmp_path / "a", [""]) == sentences.WordModel()
