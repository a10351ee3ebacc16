"""Languages: held-out stretches, labels, segments, edge cases."""

import pytest
from pyspark.sql import functions as F

from foliospark.llm import languages


@pytest.fixture(scope="module")
def model(spark):
    return languages.fitted(spark, "/root/testdata/sf0.01")


#: Sentences that don't come from the test data.
HELD = {
    "en": "We went down to the river because the weather was so nice.", "de": "Wir gingen gestern zum Fluss, weil das Wetter so schön war.", "fr": "Nous sommes allés au bord de la rivière parce qu’il faisait beau.",
    "es": "Fuimos al río porque hacía muy buen tiempo ayer por la tarde.", "pt": "Fomos até ao rio porque o tempo estava muito bom ontem à tarde.", "ru": "Мы пошли к реке, потому что погода была очень хорошей.",
    "ko": "날씨가 너무 좋아서 우리는 강으로 내려갔다.", "ja": "天気がとても良かったので、私たちは川へ行きました。", "zh": "因为天气很好，我们昨天下午去了河边。",
    "th": "เมื่อวานเราไปที่แม่น้ำเพราะอากาศดีมาก", "ar": "ذهبنا إلى النهر لأن الطقس كان جميلا جدا.", "hi": "हम नदी के पास गए क्योंकि मौसम बहुत अच्छा था।",
}


def test_unseen_sentences(model):
    p, _ = model.score(list(HELD.values()))
    got = [languages.LANGS[i] for i in p.argmax(1)]
    assert sum(a == b for a, b in zip(got, HELD, strict=True)) >= 11


def test_mixed_and_edges(model):
    mixed = HELD["en"] + " " + HELD["ru"]
    got = languages.judge(["", " \n ", "12 34", mixed, "The pump log was\nmoved to the upper\nfloor."], model)
    assert [set(g["langs"]) for g in got] == [set(), set(), set(), {"en", "ru"}, {"en"}]


def test_labels(spark):
    cases = {"EN": "en", "en_GB": "en", "zh-Hans": "zh", "Deutsch": "de", "kor": "ko", " ja-JP ": "ja", "und": None, "": None, "-": None, None: None, "English": "en"}
    df = spark.createDataFrame(list(cases.items()), "a string, b string").withColumn("got", languages.label_language(F.col("a")))
    assert all(r.got == r.b for r in df.collect())


def test_look_alikes_dont_change_the_language(model):
    p, _ = model.score(["Тhe partіal contrοl panel was compared wіth thе water balancе"])
    assert languages.LANGS[int(p.argmax())] == "en"
