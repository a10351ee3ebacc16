"""Repairs of scanned text on a small lexicon."""

import pytest

from foliospark.llm import scans

WORDS = {w: 500 for w in "the storage tank was moved to upper floor before review and long-term forecast hours within modern government describes numbers when 순서를 measurements of record".split()}
LEX = scans.Lexicon(WORDS | {"rcport": 1, "report": 900, "水泵日": 80, "泵日志": 80}, {("the", "record"): 50})


@pytest.mark.parametrize("bad,good", [("st0rage", "storage"), ("vvhen", "when"), ("clescribes", "describes"), ("nurnbers", "numbers"), ("govemment", "government"), ("witbin", "within"), ("rcport", "report"), ("순서틀", "순서를"), ("tank", None), ("xyz", None), ("tanks", None)])
def test_repair(bad, good):
    assert LEX.repair(bad, "", "") == good


def fixes(text):
    return sorted(scans.mend(text, LEX)[0])


def test_lines():
    assert fixes("the stor-\nage tank was moved to the upper floor.") == [(1, "join")]
    assert fixes("the long-\nterm forecast of the modern government was moved.") == []
    assert fixes("the stor-\n- 4 -\n\nAcme | Scope\nage tank was moved.") == [(1, "join"), (2, "drop"), (4, "drop")]
    assert fixes("the st0r-\nage tank was moved to the upper floor.") == [(1, "join"), (1, "misread")]
    assert fixes("moved within 2O14 hours and l2 hours of the record.") == [(1, "misread")]
    assert fixes("另一份水泵曰志。") == [(1, "misread")]


def test_edges():
    assert fixes("") == fixes(" \n \n") == []
    assert fixes("```\n12\nst0rage\n```") == []
    assert fixes("see https://a.example/st0rage of the record now, before review.") == []


@pytest.mark.parametrize("line,is_it", [("Page 2 of 9", True), ("— 17 —", True), ("3쪽", True), ("7/8", True), ("2014 was good.", False), ("12 valves", False)])
def test_folios(line, is_it):
    assert bool(scans._FOLIO.match(line)) == is_it


@pytest.mark.parametrize("line,is_it", [("METHOD: THE TANK", True), ("Scope · 2014  3", True), ("Acme | Scope.", True), ("12  Scope", True), ("1 Scope ....... 4", False), ("| a | b |", False), ("The tank was moved.", False), ("ISO", False)])
def test_head_forms(line, is_it):
    assert scans.is_head_form(line) == is_it


def test_key_ignores_noise():
    assert scans.head_key("MFTHOD: THE TANK  5") == scans.head_key("Method: the tank") == scans.head_key("Acme | Method: thc tank.")


def test_underlined_heading_is_no_head():
    roles = [r for _, r in scans.lines_of("Scope\n=====\n\nthe tank was moved to the upper floor.")]
    assert roles[0] == "aside"
