"""Problem 1: sentence boundaries across languages and scripts.

A semi-Markov dynamic program picks whole spans between candidate positions, of every text that has one. The score of a
span adds how likely its first word opens and its last word closes a sentence, whether quotations and brackets balance
inside it, and how likely its length is in its script.
All is learned from all running paragraphs, counted on the executors: opening and closing words from the words that begin
and end paragraphs against the words found around candidate positions, lengths from paragraphs of one sentence.

Defined results: null and blank texts give no sentence; a text without any sentence end, a heading, a contents line, a
bibliography entry gives one; repeated rows give one result; trailing white space belongs to no sentence.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field
from unicodedata import category

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, not_blank, read, spread

LEAST = 6  #: positions a word of the model is found at, at least
#: The same as a share of the paragraphs. It bounds the model: with m positions a paragraph, at most m / SHARE words each
#: of openers and closers are kept, whatever the number of paragraphs.
SHARE = 1e-4
SHORT = 4  #: characters below which a span is short
TURN = 5.0  #: cost of a span over which the depth of quotations and brackets changes

#: Words before a full stop that don't end a sentence, for texts whose words the sample doesn't hold.
ABBREVIATIONS = frozenset(
    "dr prof mr mrs ms st no nos fig figs sec ch vol pp p eq ref refs ed eds approx cf vs v rev rep tech e.g i.e a.m p.m u.k u.s "
    "nr abb abschn vgl bzw ca z b d h u a s bd kap m mme mlle art al chap env c.-à-d etc sr sra dra cap núm pág aprox ej p.ej ud uds "
    "т е д г им рис табл см напр проф ок разд гл стр с д-р ул д.р د ص ج डॉ श्री पृ सं ดร นพ พ.ศ 약".split()
)
#: Titles and other words that always go on, even before a capital.
NEVER_LAST = frozenset("dr prof mr mrs ms st no nos fig figs sec ch pp p cf vs v rev nr abb abschn vgl z d u sr sra dra art т рис табл см напр проф разд д-р д د डॉ ดร".split())

_IGNORABLE = "​‌‍⁠﻿­‎‏"
_CLOSERS = f"\"”’»」』）)\\]】›{_IGNORABLE}"
_TERMS = ".!?…。！？．｡؟।॥۔"
_CAND = re.compile(rf"(?:[{_TERMS}][{_IGNORABLE}]*)+(?:[\s]?[»](?=[\s]|$)|[{_CLOSERS}]|“(?=[\s,;]|$))*")
_THAI_SPACE = re.compile(r"(?<=[ก-๛”»\"')\]0-9" + _IGNORABLE + r"])[ \n    　]+(?=[ก-๛“(\"" + _IGNORABLE + r"0-9])")
_THAI = re.compile(r"[ก-๛]")
_HANGUL = re.compile(r"[가-힣]")
_MARKS = re.compile(r"[“”„«»「」『』（）()\[\]\"‘’]")
_LIST_MARK = regex.compile(r"\s*(?:[(（]?(?:\d{1,3}|\p{L}|[ivxIVX]{1,4})[.)）．]|\[\d+\]|[•·▪‣*–-])[\s.]*$")
_BREAKS = frozenset(" \n\t\u00a0,;:()[]\"“”„«»「」『』（）。！？、，")
_FIRST_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_OPEN_MARKS = re.compile(r"[\s“„«「『（(\"‘¿¡\[" + _IGNORABLE + r"]*")
_CONTENTS = re.compile(r"(?:\.{4,}|…{2,}|·{4,}|(?:\. ){4,})\s*[\divxIVX]+\s*$")
_BIB = regex.compile(r"^\s*(?:[\[(]?\d{1,3}[\]).]+\s*)?\p{Lu}[\p{L}'’-]+,\s*(?:\p{Lu}\.[\s-]?)+.*\d{4}[a-z]?\)?\.?\s*$", regex.S)
_YEAR = re.compile(rf"(?:\d[{_IGNORABLE}]*){{4}}[a-z]?\)?\.?[{_IGNORABLE}]*$")
_WIDE = re.compile(r"[！-～]")
_FOLD = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)} | {0x3000: 0x20}
#: Cyrillic and Greek letters beside the Latin letters that look the same.
_CYRILLIC = "аеорсухѕіјАВЕКМНОРСТХЅІЈ"
_CYRILLIC_LATIN = "aeopcyxsijABEKMHOPCTXSIJ"
_GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧο"
_GREEK_LATIN = "ABEZHIKMNOPTYXo"
_TO_LATIN = str.maketrans(_CYRILLIC + _GREEK, _CYRILLIC_LATIN + _GREEK_LATIN)
_TO_CYRILLIC = str.maketrans(_CYRILLIC_LATIN[:7] + _CYRILLIC_LATIN[10:21], _CYRILLIC[:7] + _CYRILLIC[10:21])
_TWIN = re.compile(f"[{_CYRILLIC}{_GREEK}]")
_CYRILLIC_ONLY = re.compile(r"[бвгдёжзийклмнптфцчшщъыьэюяБГДЖЗИЛПУФЦЧШЩЭЮЯ]")
_FOLD.pop(0xFF01), _FOLD.pop(0xFF1F)  # ！ and ？ end sentences without a space after them
_UNSPACED = re.compile(r"[぀-ヿ㐀-鿿豈-﫿ｦ-ﾟ]")
_CJK_TERMS = frozenset("。！？｡")
_CLOSE_OF = {"“": "”", "„": "“", "«": "»", "「": "」", "『": "』", "（": "）", "(": ")", "[": "]", "‘": "’", '"': '"'}


@dataclass(slots=True)
class WordModel:
    """Log odds of words as openers and closers; empty: only the fixed abbreviations hold."""

    opens: dict[str, float] = field(default_factory=dict)
    closes: dict[str, float] = field(default_factory=dict)
    lengths: dict[str, tuple[float, float]] = field(default_factory=dict)  # mean and deviation of log length by script


def _opener(text: str, at: int) -> str:
    """The word that begins at or after `at`; two characters of scripts without spaces, four of Thai."""
    at = _OPEN_MARKS.match(text, at).end()
    if at >= len(text):
        return ""
    c = text[at]
    if "฀" <= c <= "๿":
        return text[at : at + 4]
    if _UNSPACED.match(c):
        return text[at] + ("0" if text[at + 1 : at + 2].isdigit() else text[at + 1 : at + 2])
    if not text.isascii() and _IGNORES.search(text, at, at + 24):
        text, at = text[at : at + 30].translate(_DROP), 0
    m = _FIRST_WORD.match(text, at)
    if m and text[m.end() : m.end() + 2] == "-\n":
        return ""  # a word broken across lines says nothing
    return "0" if c.isdigit() else m.group()[:24] if m else c


def _closer(text: str, start: int) -> str:
    """The word that ends right before `start`, lower case."""
    if start and "฀" <= text[start - 1] <= "๿":
        return text[start - 4 : start]
    low = max(0, start - 24)
    k = start
    while k > low and ((c := text[k - 1]) not in _BREAKS and (c.isalnum() or c in "'’-." or c in _IGNORABLE or category(c)[0] == "M")):
        k -= 1
    word = text[k:start]
    if not word.isascii() and _IGNORES.search(word):
        word = word.translate(_DROP)
    word = word.lower().lstrip(".-'’")
    if word[:1].isdigit() and not word[-1].isdigit():  # a number before a unit or an ending: one word whatever the number
        word = "0" + word.lstrip("0123456789.,-")
    return word


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(end of the unit, start of its last mark, start of what follows) of each position where a sentence may end."""
    out, n = [], len(text)
    for m in _CAND.finditer(text):
        s, e = m.span()
        if e >= n:
            break
        c, t = text[e], text[s]
        if c.isspace():
            out.append((e, s, e + 1))
        elif t in _CJK_TERMS or t in "।॥" or (t in "．.!?؟" and s and (
            (text[s - 1].isalnum() or text[s - 1] in ")]”»\"" or t != ".") and c.isalpha() and ((c.isupper() and (text[e + 1 : e + 2].islower() or text[e + 1 : e + 2] in "’'" or c in "AIOEY" and text[e + 1 : e + 2] == " ") or c.islower() and text[e + 1 : e + 2].isupper()) and (text[s - 1].islower() or text[s - 1] in ")]”»\"" or text[s - 1].isdigit()) or "가" <= c <= "힣" and not text[s - 1].isdigit() or "؀" <= c <= "ۿ" or c in "“«¿¡"))):
            out.append((e, s, e))
    if not text.isascii() and _THAI.search(text):
        out = sorted({(m.start(), m.start(), m.end()) for m in _THAI_SPACE.finditer(text)} | set(out))
    return out


def _depths(text: str, ends: list[int]) -> list[int]:
    """How many quotations and brackets are open at each of the rising positions."""
    out, stack, k = [], [], 0
    for m in _MARKS.finditer(text):
        p, c = m.start(), m.group()
        while k < len(ends) and ends[k] <= p:
            out.append(len(stack))
            k += 1
        if stack and _CLOSE_OF[stack[-1]] == c:
            stack.pop()
        elif c in "“„«「『（([\"":
            stack.append(c)
        elif c == "‘":
            stack.append(c)
        elif c != "’":
            for q in range(len(stack) - 1, -1, -1):
                if _CLOSE_OF[stack[q]] == c:
                    del stack[q:]
                    break
    return out + [len(stack)] * (len(ends) - k)


def is_one_unit(text: str, kind: str | None) -> bool:
    """Headings, contents lines and bibliography entries are one unit each."""
    if kind == "heading":
        return True
    tail = text[-40:].rstrip()
    if tail[-1:].isalnum() and _CONTENTS.search(tail):
        return True
    if not _YEAR.search(tail):
        return False
    return bool(_BIB.match(text.translate(_DROP) if _IGNORES.search(text) else text))


_IGNORES = re.compile(f"[{_IGNORABLE}]")
_DROP = dict.fromkeys(map(ord, _IGNORABLE))


def _score(text: str, c: tuple[int, int, int], model: WordModel) -> float:
    """Log odds that a sentence ends at the candidate and another begins after it."""
    end, mark, nxt = c
    thai = end == mark
    close, first = _closer(text, mark), _opener(text, nxt)
    o = model.opens.get(first, 0.0)
    if thai:
        if first[:1].isdigit() or text[nxt : nxt + 1] == "(":
            return -6.0
        return 1.0 + o + (0.5 * model.closes.get(close, 0.0) if not close[-1:].isdigit() else -3.0)
    if _LIST_MARK.match(text, 0, end):
        return -20.0
    term = text[mark]
    at = _OPEN_MARKS.match(text, nxt).end()
    c1 = text[at : at + 1]
    score = 2.0 + o
    if at == end and text[end - 1] in "”」』’" and text.startswith(_GOES_ON, at):
        return score - 8.0
    if term in _CJK_TERMS or term in "।॥":
        return score - (0.7 if text[end - 1] in "”」』’" else 0) + (0 if term != "।" else 1)
    if term == "…" or text.count(".", mark, end) > 1:
        score -= 2.5 if c1.isupper() else 6.0
    if c1.islower() and not text[at + 1 : at + 2].isupper():
        return score - 8.0
    if term in ".．" and close and text.count(".", mark, end) < 2:
        if "." in close and close not in model.closes and close not in ABBREVIATIONS and len(tail := close.rpartition(".")[2]) > 1:
            close = tail
        if close in NEVER_LAST:
            return score - 6.0
        w = model.closes.get(close)
        if w is not None:
            score += w
        elif close in ABBREVIATIONS:
            score -= 3.0
        if len(close) == 1 and close.isalpha() and (text[mark - 1].isupper() or c1.isdigit()):
            score -= 5.0
        if c1.isdigit() and close in ABBREVIATIONS:
            score -= 4.0
    if not c1:
        return score
    if text[end - 1] in "”»’“\"" and not c1.isupper():
        score -= 1.5
    return score


#: Weight of squared deviations of log length, and how many deviations count: beyond, the term is constant.
LENGTH_WEIGHT, LENGTH_CLIP = 0.25, 2.0
#: What goes on after a quotation that closes without a space.
_GOES_ON = ("と", "って", "という", "などと", "라고", "이라고", "하고", "라는", "이라는", "라며", "라면서")


def script_of(text: str) -> str:
    """The kind of writing that lengths are learned by: Hangul, characters that need no spaces, Thai, or other words."""
    if text.isascii():
        return "w"
    return "k" if _HANGUL.search(text) else "c" if _UNSPACED.search(text) else "t" if _THAI.search(text) else "w"


def _length(n: int, of: tuple[float, float] | None = None) -> float:
    """Log likelihood of a length, up to a constant, clipped; and a penalty on very short units."""
    short = -0.8 if n < SHORT else 0.0
    if of is None:
        return short
    z = (math.log(max(1, n)) - of[0]) / of[1]
    return short - LENGTH_WEIGHT * min(LENGTH_CLIP * LENGTH_CLIP, z * z)


def split(text: str, kind: str | None = None, model: WordModel = WordModel()) -> list[int]:
    """End positions (characters up to and including the last non-space one) of the sentences of a text."""
    last = len(text.rstrip())
    if not last:
        return []
    if kind == "heading":
        return [last]
    plain = text.isascii()
    if not plain and _WIDE.search(text):
        text = text.translate(_FOLD)
    if not plain and _TWIN.search(text):
        text = text.translate(_TO_CYRILLIC if _CYRILLIC_ONLY.search(text) else _TO_LATIN)
    if is_one_unit(text, kind):
        return [last]
    cands = [c for c in candidates(text) if c[0] < last]
    if not cands:
        return [last]
    ends = [c[0] for c in cands] + [last]
    depth = _depths(text, ends)
    score = [_score(text, c, model) for c in cands] + [0.0]
    of = model.lengths.get(script_of(text))
    far = SHORT if of is None else max(SHORT, math.exp(of[0] + LENGTH_CLIP * of[1]))  # from here on the length counts the same
    constant = 0.0 if of is None else -LENGTH_WEIGHT * LENGTH_CLIP * LENGTH_CLIP
    starts = [0] + [c[2] for c in cands]
    base = [0] + depth
    best, back = [0.0], [0]
    # of the starts that are far, the first best of each depth and of all: the program is linear
    same, top_all, low = {}, None, 0
    for j in range(1, len(ends) + 1):
        e, d = ends[j - 1], depth[j - 1]
        while low < j and e - starts[low] >= far:
            if base[low] not in same or best[low] > best[same[base[low]]]:
                same[base[low]] = low
            if top_all is None or best[low] > best[top_all]:
                top_all = low
            low += 1
        top, arg = -math.inf, 0
        for i in (same.get(d), top_all):
            if i is not None and (v := (best[i] + constant - (TURN if base[i] != d else 0.0), -i)) > (top, arg):
                top, arg = v
        for i in range(low, j):
            if (v := (best[i] + _length(e - starts[i], of) - (TURN if base[i] != d else 0.0), -i)) > (top, arg):
                top, arg = v
        best.append(top + score[j - 1])
        back.append(-arg)
    out, j = [], len(ends)
    while j:
        out.append(ends[j - 1])
        j = back[j]
    return [len(text[:e].rstrip()) if text[e - 1].isspace() else e for e in reversed(out)]


def counts(texts: list[str]) -> tuple[Counter, Counter, Counter, Counter, Counter]:
    """Of running texts: paragraphs' first words, words after candidate positions, last words, words before them; and of
    those of one sentence number, sum and sum of squares of log length by script, in thousandths."""
    starts, ends, before, after, lengths = Counter(), Counter(), Counter(), Counter(), Counter()
    for t in texts:
        body = t.rstrip()
        if is_one_unit(t, None) or len(body) < 20:
            continue
        m = regex.match(r"\s*(?:[(]?(?:\d{1,3}|\p{L})[.)]|[•*–-])\s+", body)
        starts[_opener(body, m.end() if m else 0)] += 1
        stop = len(body)
        while stop and body[stop - 1] in _TERMS + "\"”’»」』）)]“ " + _IGNORABLE:
            stop -= 1
        ends[_closer(body, stop)] += 1
        cands = candidates(body)
        for _, mark, nxt in cands:
            before[_closer(body, mark)] += 1
            after[_opener(body, nxt)] += 1
        if not cands and body[-1] not in ",;:、，":
            k, x = script_of(body), math.log(len(body))
            lengths[k, 0] += 1000
            lengths[k, 1] += round(1000 * x)
            lengths[k, 2] += round(1000 * x * x)
    for c in (starts, ends, before, after):
        c.pop("", None)
    return starts, after, ends, before, lengths


def model_of(starts: Counter, after: Counter, ends: Counter, before: Counter, lengths: Counter, totals: tuple[int, int, int, int], least: float) -> WordModel:
    """The word model of counts; totals: the sums over all words, kept or not."""
    ns, na, ne, nb = (max(1, t) for t in totals)
    odds = lambda a, n, b, m: max(-6.0, min(1.0, math.log(((a + 0.3) / n) / ((b + 0.3) / m))))
    spread_of = {}
    for k in "wkct":
        if (n := lengths[k, 0] / 1000) >= LEAST:
            mean = lengths[k, 1] / 1000 / n
            spread_of[k] = (mean, max(0.2, lengths[k, 2] / 1000 / n - mean * mean) ** 0.5)
    return WordModel(
        {w: odds(starts[w], ns, c, na) for w, c in after.items() if c >= least},
        {w: odds(ends[w], ne, c, nb) for w, c in before.items() if c >= least and not w[-1:].isdigit()},
        spread_of,
    )


def fit(texts: list[str]) -> WordModel:
    """The word model of running texts: paragraphs' first and last words against words around candidate positions."""
    c = counts(texts)
    return model_of(*c, tuple(sum(x.values()) for x in c[:4]), max(LEAST, SHARE * len(texts)))


def fitted(spark: SparkSession, sf_dir: str) -> WordModel:
    """The word model of all running paragraphs. Only the words it keeps, and the sums, reach the driver."""
    df = read(spark, sf_dir, "odl_paragraphs", "kind", "text").where(F.col("kind").isin("paragraph", "text block", "list item") & (F.length("text") > 40)).select("text")
    least = max(LEAST, SHARE * df.count())

    def run(b: pa.RecordBatch) -> dict:
        starts, after, ends, before, lengths = counts(b.column(0).to_pylist())
        out = {"opener": [], "word": [], "edge": [], "inner": []}
        for opener, edge, inner in ((True, starts, after), (False, ends, before)):
            words = [*(edge | inner)]
            out["opener"] += [opener] * (len(words) + 1)
            out["word"] += [*words, ""]  # the empty word, never counted itself, holds the sums
            out["edge"] += [*(edge[w] for w in words), sum(edge.values())]
            out["inner"] += [*(inner[w] for w in words), sum(inner.values())]
        for (k, i), n in lengths.items():
            out["opener"].append(None)
            out["word"].append(f"{k}{i}")
            out["edge"].append(n)
            out["inner"].append(0)
        return out

    words = arrow_map(spread(df), run, "opener boolean, word string, edge bigint, inner bigint").groupBy("opener", "word").agg(F.sum("edge").alias("edge"), F.sum("inner").alias("inner"))
    kept = words.where((F.col("inner") >= least) | (F.col("word") == "") | F.col("opener").isNull()).toArrow().to_pylist()
    lengths = Counter({(r["word"][0], int(r["word"][1])): r["edge"] for r in kept if r["opener"] is None})
    sums = {r["opener"]: (r["edge"], r["inner"]) for r in kept if not r["word"]}
    pick = lambda opener, col: Counter({r["word"]: r[col] for r in kept if r["word"] and r["opener"] == opener})
    return model_of(pick(True, "edge"), pick(True, "inner"), pick(False, "edge"), pick(False, "inner"), lengths, sums.get(True, (0, 0)) + sums.get(False, (0, 0)), least)


def split_sentences(df: DataFrame, model: WordModel, id_col: str = "para_id", text_col: str = "text", kind_col: str = "kind") -> DataFrame:
    """(id, ends): the end positions of the sentences of each row with a non-blank text, in text order."""

    def run(b: pa.RecordBatch) -> dict:
        texts, kinds = b.column(1).to_pylist(), b.column(2).to_pylist()
        return {id_col: b.column(0), "ends": [split(t, k, model) for t, k in zip(texts, kinds, strict=True)]}

    kind = df.schema[id_col].dataType.simpleString()
    return arrow_map(df.where(not_blank(text_col)).select(id_col, text_col, kind_col), run, f"{id_col} {kind}, ends array<bigint>")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per sentence of each non-blank paragraph."""
    df = spread(read(spark, sf_dir, "odl_paragraphs", "para_id", "text", "kind"))
    ends = split_sentences(df, fitted(spark, sf_dir))
    one = ends.groupBy("para_id").agg(F.array_distinct(F.flatten(F.collect_set("ends"))).alias("ends"))
    return one.select("para_id", F.explode("ends").alias("end_pos"))
