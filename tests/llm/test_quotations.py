"""Quotations and list marks inside sentences, without any learned word."""

import pytest

from foliospark.llm.sentences import WordModel, script_of, split

LENGTHS = WordModel(lengths={"w": (4.4, 0.6), "c": (3.5, 0.8), "k": (4.0, 0.7), "t": (4.1, 0.6)})


@pytest.mark.parametrize("model", [WordModel(), LENGTHS])
@pytest.mark.parametrize(
    "text,units",
    [
        ("「行くよ。」と彼は言った。", 1), ("彼は「わからない。困った。」と述べた。次の文。", 2), ("“준비되었는가? 다시 확인하라.”라고 적었다. 다음 문장이 이어진다.", 2),
        ("He cites (" + ", ".join(f'"x" fig. {i}' for i in range(40)) + ") as proof.", 1), ("“Is it ready? Check it again.” was the only remark. The next one follows here.", 2), ("", 0), (" \n ", 0), ("no end at all", 1),
    ],
)
def test_units(text, units, model):
    assert len(split(text, None, model)) == units


def test_scripts():
    assert [script_of(t) for t in ("abc", "日本語", "한국어", "ภาษา", "текст")] == ["w", "c", "k", "t", "w"]
