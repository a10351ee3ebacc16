"""Page steps and rule files on small cases."""

import itertools
import random

import pytest

from foliospark.operators import flow, frontmatter, rules
from foliospark.plans import catalogue

TINY = "/root/testdata/sf0.001"


def test_reflow():
    assert flow.reflow("") == ""
    assert flow.reflow("one two\nthree.\nFour\n\nfive") == "one two three.\nFour\n\nfive"
    assert flow.reflow("日本\n語の文") == "日本語の文"
    assert flow.reflow("# Head\ntext\n- item\n| a |\n| b |") == "# Head\ntext\n- item\n| a |\n| b |"
    assert flow.reflow("```\na\nb\n```\nc\nd") == "```\na\nb\n```\nc d"


def test_merge():
    b = lambda t, y, k="paragraph": {"kind": k, "text": t, "bbox": [10, y, 100, y + 10]}
    got = flow.merge_paragraphs([b("goes", 100), b("on here.", 88), b("Next", 76), b("1. item", 64), b("far", 20), b("head", 8, "heading")])
    assert [g["text"] for g in got] == ["goes on here.", "Next", "1. item", "far", "head"]
    assert got[0]["bbox"] == [10, 88, 100, 110]
    assert flow.merge_paragraphs([]) == []
    assert len(flow.merge_paragraphs([{"kind": "paragraph", "text": "a", "bbox": None}, b("b", 1)])) == 2


def test_align():
    assert flow.align(["the storage tank", "the storage unit", "short"], ["the storage units", "the storage tanks", "shorter"]) == [1, 0, None]
    assert flow.align([], ["x"]) == [] and flow.align(["long enough text"], []) == [None]


def test_clusters_against_brute_force():
    r = random.Random(2)
    for _ in range(30):
        boxes = []
        for _ in range(25):
            x, y = r.uniform(0, 300), r.uniform(0, 300)
            boxes.append([x, y, x + r.uniform(1, 30), y + r.uniform(1, 30)])
        near = lambda a, b: a[0] <= b[2] + 12 and b[0] <= a[2] + 12 and a[1] <= b[3] + 12 and b[1] <= a[3] + 12
        group = list(range(25))
        for _ in range(25):
            for i, j in itertools.combinations(range(25), 2):
                if near(boxes[i], boxes[j]):
                    group[i] = group[j] = min(group[i], group[j])
        assert flow.clusters(boxes) == group
    assert flow.clusters([]) == []


def test_figures():
    paths = [[100 + 5 * i, 100, 104 + 5 * i, 160] for i in range(12)]
    assert flow.figures(paths, [], [], 600, 800) == [[86, 86, 173, 174]]
    assert flow.figures(paths[:7], [], [], 600, 800) == []
    assert flow.figures(paths, [[90, 90, 170, 170]], [], 600, 800) == []
    assert flow.figures(paths, [], [[80, 80, 180, 180]], 600, 800) == []


def test_table_similarity():
    t = "<table><tr><td>a</td><td>b</td></tr><tr><td>c</td><td>d</td></tr></table>"
    assert flow.table_similarity(t, t) == 1 and flow.table_similarity("", "") == 1
    assert flow.table_similarity(t, t.replace("d</td>", "x</td>")) == pytest.approx(1 - 1 / 7)
    assert flow.table_similarity(t, "<table><tr><td>a</td><td>b</td></tr></table>") == pytest.approx(1 - 3 / 7)
    assert flow.match_tables([("T1", t), (None, t)], [(None, t), ("t1 ", "<table></table>")]) == [pytest.approx(1 / 7), 1]
    assert flow.match_tables([(None, t)], []) == [0.0]


FILE = """---
id: own/rules   # a comment
version: 1.0.0
zones: [body, 'references']
rules:
  - {id: one, when: {all: [{page_frac: {gte: 0.4}}, {text_matches: '(?i)^a, b: {c}$'}]}, then: {zone: references, opens_zone: true}}
  - {id: rest, when: {}, then: {type: paragraph}}
policy:
  child_tokens: 384
  deep:
    x: null
---
prose
"""


def test_rule_file(spark):
    got = frontmatter.parse(FILE)
    assert got["id"] == "own/rules" and got["zones"] == ["body", "references"] and got["policy"] == {"child_tokens": 384, "deep": {"x": None}} and len(got["sha256"]) == 64
    df = spark.createDataFrame([("A, b: {c}", 0.5), ("x", 0.5)], "text string, page_frac double")
    clause = got["rules"][0]["when"]
    clause["all"][1]["text_matches"] = clause["all"][1]["text_matches"].replace("{c}", r"\{c\}")
    assert df.where(rules.predicate(clause)).count() == 1


@pytest.mark.parametrize("bad", ["no head", "---\nid: x\n---\n", "---\nid: x\nversion: 1\nrules:\n  - {id: a}\n---\n", "---\nid: x\nversion: 1\nz: [a\n---\n", "---\nid: x\n    y: 1\nversion: 2\n---\n"])
def test_bad_rule_files(bad):
    with pytest.raises(ValueError):
        frontmatter.parse(bad)


def test_page_queries(spark):
    q = catalogue.QUERIES
    assert q["win20_reflow"](spark, TINY).count() == spark.read.parquet(f"{TINY}/page_outcomes.parquet").where("markdown IS NOT NULL").select("out_id").distinct().count()
    assert q["jon06_alignment"](spark, TINY).groupBy("out_id", "line_no").count().where("count > 1").count() == 0
    assert all(0 <= r.similarity <= 1 for r in q["evl04_jon18_tables"](spark, TINY).collect())
    merged = q["win03_merged"](spark, TINY)
    assert 0 < merged.count() <= spark.read.parquet(f"{TINY}/odl_paragraphs.parquet").count()
    assert q["win22_clusters"](spark, TINY).count() > 0


def test_stitch():
    assert flow.stitch([]) == "" and flow.stitch([None, " ", ""]) == ""
    assert flow.stitch(["one goes", "on here.", "Next"]) == "<!-- page 1 -->\n\none goes <!-- page 2 -->on here.\n\n<!-- page 3 -->\n\nNext"
    assert flow.stitch(["a bro-", "ken word"]) == "<!-- page 1 -->\n\na bro<!-- page 2 -->ken word"
    assert flow.stitch(["日本語", "の文"]) == "<!-- page 1 -->\n\n日本語<!-- page 2 -->の文"
    assert "\n\n" in flow.stitch(["| a |", "b"])[16:]


def test_relevel():
    assert flow.relevel("# 1.2 Scope\n### 3 Method\n# Plain\n```\n# 1.1 x\n```\n## 2020 2021") == "## 1.2 Scope\n# 3 Method\n# Plain\n```\n# 1.1 x\n```\n## 2020 2021"
