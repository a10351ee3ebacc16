"""Problem 9: texts cut by a field limit or in transfer, and how often each source cuts.

Intact texts of a bounded hash sample (SAMPLE) are cut at random places, bare or with a mark of cutting, and a logistic
regression over hashed features learns them against the intact ones: closing characters and their shape, what line and
what open mark the text ends in, whether its last word is a word, and how its length stands to its source's limit. Every
record is scored. A source's limit is a length, in characters or in bytes, that many of its distinct texts share and hardly
any exceeds; it is found from the counts of all lengths of all sources. What a limit proves of a text with a whole ending is
learned from the sample: they count as cut there by the share that cuts at random places would leave.

Defined results: null, empty and blank texts and lone numbers aren't cut; a text that ends in a caption, link, list, table, code, name or
bibliography line is whole unless it bears a mark, or stands at a limit where chance leaves most such endings; an announcement that the text is to
be continued is a note of its author, and the text before it is what is judged; rows without a source have no limit of their own.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_map, hashed_sample, read, spread

SAMPLE = 5000  #: texts learned from
SAMPLE_CHARS = 20_000  #: length up to which a text is learned from, so that what reaches the driver is bounded; all are scored
BUCKETS = 1 << 14
LIMITED = 0.35  #: share of the artificial cuts that stand at a limit
LONG = 8  #: characters that a Thai ending is known by
LEAST_LIMIT = 64  #: characters below which a length that recurs is no limit

#: Marks that cutting leaves behind.
MARKS = re.compile(r"(?:…|\.\.\.|\[\.\.\.\]|\[…\]|\(\.\.\.\)|�|\((?:cont|more)[^)\n]{0,12}\)?|\[(?:cont|more|truncated)[^\]\n]{0,12}\]?|(?:read more|continued|<truncated>)\s*(?:\.\.\.|…)?)\s*\Z", re.I)
#: Fixed value: an author's announcement behind a sentence or on a line of its own; whoever cuts a text doesn't write it.
NOTE = re.compile(r"(?:\A|\n|(?<=[.!?。！？।؟॥．｡\"”»」』)]))\s*[(\[]?to be continued\s*(?:\.{1,3}|…)?[)\]]?\s*\Z", re.I)
_ENTITY = re.compile(r"&#?\w{0,7}\Z|\\\w*\Z|<[^<>\n]{0,80}\Z")
_END = "[.!?。！？।؟॥．｡]"
_CLOSE = r"[\"'”»’」』)\]）*_​-‏⁠﻿]"
_WHOLE = re.compile(rf"{_END}(?:{_CLOSE}|[ \u00a0\u202f][»›”])*\s*\Z")
_KINDS = (
    ("fence", re.compile(r"^\s*(?:```+|~~~+)\s*$")), ("table", re.compile(r"^\s*\|.*\|\s*$")), ("tablecut", re.compile(r"^\s*\|")), ("link", re.compile(r"^\s*<?https?://\S+$")),
    ("omitted", re.compile(r"^\s*\[[^\]]+\]\s*$")), ("cite", re.compile(r"^\s*\([^()]+,\s*\d{4}[a-z]?\)\s*$")), ("name", re.compile(r"^\s*[—–]\s+\S")),
    ("biblio", re.compile(r"(?:\b(?:Rep|Proc|J|Vol|pp|Press)\b\.?).*\d{4}\.?\s*$")), ("heading", re.compile(r"^\s*#{1,6}\s")),
    ("caption", re.compile(r"^\s*(?:fig(?:ure|ura|\.)?|tab(?:le|la|ela|leau|elle|\.)?|abb(?:ildung|\.)?|рис(?:унок|\.)?|табл(?:ица|\.)?|그림|표|図|表|图|รูปที่|ตารางที่|الشكل|الجدول|شكل|جدول|चित्र|तालिका)\s*[\d٠-٩]+(?:-\d+)?[.:：]?(?:\s|$)", re.I)),
    ("item", re.compile(r"^\s*(?:[-*+•·]|\(?\d{1,3}[.)]|[a-z]\))\s+\S")),
)
_NUMBER = re.compile(r"\s*[\d.,]*\d\s*\Z")
_DIGIT = re.compile(r"\d")
_LAST = re.compile(r"[^\W\d_]+\Z")
_OPEN = {"(": ")", "[": "]", "“": "”", "«": "»", "「": "」", "『": "』", "（": "）"}


def _script(c: str) -> str:
    o = ord(c)
    for name, a, b in (("l", 0, 0x24F), ("c", 0x400, 0x52F), ("a", 0x600, 0x6FF), ("d", 0x900, 0x97F), ("t", 0xE00, 0xE7F), ("j", 0x3040, 0x30FF), ("h", 0x3400, 0x9FFF), ("k", 0xAC00, 0xD7A3)):
        if a <= o <= b:
            return name
    return "o"


def _letter(s: str) -> str:
    """The script of the last letter."""
    return _script(next((c for c in reversed(s[-40:]) if c.isalpha()), s[-1:] or "o"))


def _shape(s: str) -> str:
    return "".join("U" if c.isupper() else "l" if c.islower() else "d" if c.isdigit() else "x" if c.isalpha() else " " if c.isspace() else c for c in s)


class Words:
    """Whole words and line endings of the sample."""

    def __init__(self, texts: list[str]):
        self.words: Counter = Counter()
        self.tails: Counter = Counter()
        self.inner: Counter = Counter()
        self.spaced: Counter = Counter()  # of Thai, whose sentences end at a space: longer endings
        self.among: Counter = Counter()
        self.lines: Counter = Counter()
        for t in texts:
            ls = [x.rstrip() for x in t.split("\n") if x.strip()]
            for k, line in enumerate(ls):
                ws = re.findall(r"[^\W\d_]+", line)
                self.words.update(set(ws[:-1] if k == len(ls) - 1 else ws))
                line = _DIGIT.sub("0", line)
                parts = line.split(" ") if "ก" <= line[-1:] <= "๛" or "ก" <= line[:1] <= "๛" else [line]  # Thai sentences end at a space
                for part in parts[: -1 if k == len(ls) - 1 else None]:
                    self.tails[part[-3:]] += 1
                if _letter(line) == "t":
                    stops = [i for i, c in enumerate(line) if c == " "] + [len(line)] * (k < len(ls) - 1)
                    self.spaced.update(line[max(0, i - LONG) : i] for i in stops)
                    self.among.update(line[i : i + LONG] for i in range(LONG, len(line) - LONG, 2))
                if k < len(ls) - 1 and len(line) < 100:
                    self.lines[line.strip()] += 1
                for i in range(8, len(line) - 3, 5):
                    self.inner[line[i : i + 3]] += 1
        self.nt, self.ni = max(1, self.tails.total()), max(1, self.inner.total())
        self.ns, self.na = max(1, self.spaced.total()), max(1, self.among.total())
        self.lines = Counter({x: n for x, n in self.lines.items() if n > 1})
        self.words = Counter({w: n for w, n in self.words.items() if n > 1})
        self.prefixes = {w[:i] for w in self.words for i in range(1, len(w))}

    def tail(self, t: str) -> int:
        """How much likelier the last characters end a line than stand inside one, in steps."""
        s = _DIGIT.sub("0", t[t.rfind("\n") + 1 :][-LONG:])
        near = ((self.tails[s[-3:]] + 0.05) / self.nt) / ((self.inner[s[-3:]] + 0.05) / self.ni)
        far = ((self.spaced[s] + 0.05) / self.ns) / ((self.among[s] + 0.05) / self.na) if _letter(t) == "t" else 0.0
        return int(np.clip(round(np.log(max(near, far))), -5, 5))

    def last(self, t: str) -> str:
        m = _LAST.search(t[-40:])
        if not m:
            return "none"
        w = m.group()
        return "word" if self.words[w] > 1 else "prefix" if w in self.prefixes else "unseen"


def end_line(text: str) -> tuple[str, str]:
    """(kind, text) of the line a text ends in."""
    body = text.rstrip()
    line = body[body.rfind("\n") + 1 :]
    if body.count("```") % 2 or body.count("~~~") % 2:
        return "incode", line
    for kind, pattern in _KINDS:
        if pattern.search(line):
            return kind, line
    return "text", line


def features(text: str, declared: int | None, at_limit: str, words: Words) -> list[int]:
    """Buckets of what the end of a text looks like."""
    body = text.rstrip()
    kind, line = end_line(text)
    mark = MARKS.search(body)
    core = body[: mark.start()].rstrip() if mark else body
    whole = bool(_WHOLE.search(core))
    script = _letter(core)
    tail, last = words.tail(body), words.last(core)
    opened = "".join(o for o, c in _OPEN.items() if line.count(o) > line.count(c)) + ('"' if line.count('"') % 2 else "")
    over = "no" if declared is None or declared <= len(text) else "bytes" if declared == len(text.encode("utf-8", "replace")) else "over"
    lone = "end" if whole else "bare"
    seen = bool(words.lines[_DIGIT.sub("0", line).strip()])
    short = "tiny" if len(body) < 15 else "line" if "\n" not in body and len(body) < 40 else "long"
    f = [
        f"1{body[-1:]}", f"2{body[-2:]}", f"3{body[-3:]}", f"s{_shape(body[-5:])}", f"k{kind}", f"k{kind}|{lone}", f"k{kind}|{last}", f"w{lone}|{script}", f"w{lone}|{last}",
        f"t{tail}", f"t{tail}|{script}|{lone}", f"t{tail}|{kind}", f"o{opened}", f"o{bool(opened)}|{lone}", f"l{at_limit}", f"l{at_limit}|{lone}", f"d{over}", f"m{mark.group().strip() if mark else ''}",
        f"m{bool(mark)}", f"m{bool(mark)}|{lone}", f"e{bool(_ENTITY.search(body))}", f"n{short}|{lone}", f"sp{text[-1:].isspace()}|{lone}", f"k{kind}|m{bool(mark)}", f"L{seen}|{kind}", f"L{seen}|{lone}|{bool(mark)}",
    ]
    return [crc32(x.encode("utf-8", "replace")) % BUCKETS for x in f]


class Model:
    def __init__(self, words: Words, weights: np.ndarray):
        self.words, self.weights = words, weights

    def score(self, text: str, declared: int | None, at_limit: str) -> float:
        text, declared, at_limit = judged(text, declared, at_limit)
        if not any(c.isalnum() for c in text) or at_limit == "no" and _NUMBER.match(text):
            return 0.0
        z = float(self.weights[features(text, declared, at_limit, self.words)].sum() + self.weights[-1])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def judged(text: str, declared: int | None, at_limit: str) -> tuple[str, int | None, str]:
    """The text before an author's announcement, and its declared length; what ends in one in full isn't cut by a limit."""
    if not (note := NOTE.search(text)):
        return text, declared, at_limit
    return text[: note.start()], None if declared is None else declared - (len(text) - note.start()), "no"


def closed(text: str, words: Words) -> bool:
    """Whether a text ends as whole texts do, and not in white space or an open quotation or bracket."""
    kind, line = end_line(text)
    if text[-1:].isspace() or any(line.count(o) > line.count(c) for o, c in _OPEN.items()) or line.count('"') % 2:
        return False
    if kind in ("fence", "table", "link", "omitted", "cite", "name", "biblio") or words.lines[_DIGIT.sub("0", line).strip()]:
        return True
    return kind in ("text", "caption", "item") and (bool(_WHOLE.search(text)) or words.tail(text.rstrip()) >= 2)


def intact(text: str, declared: int | None, at_limit: str, words: Words) -> bool:
    """Whether a text is taken for whole in training."""
    if at_limit != "no" or MARKS.search(text.rstrip()) or not text.strip() or _ENTITY.search(text):
        return False
    if declared is not None and declared > len(text) and declared != len(text.encode("utf-8", "replace")):
        return False
    kind, line = end_line(text)
    if kind == "item" and words.last(text.rstrip()) in ("word", "none") or words.lines[_DIGIT.sub("0", line).strip()] or not any(c.isalpha() for c in text):
        return True
    return bool(_WHOLE.search(text)) or kind in ("fence", "table", "link", "omitted", "cite", "name", "biblio", "caption") or words.tail(text.rstrip()) >= 2


def cut_at_random(r: random.Random, text: str) -> str:
    n = r.randint(min(20, len(text) // 2), len(text) - 1)
    t = text[:n]
    q = r.random()
    if q < 0.6:
        return t
    return t + r.choice(("…", "...", " [...]", "[...]", "�", " (cont", "\n(continued)", "&am", " …"))


def chance(rows: list[tuple[str, int | None, str]], good: list[tuple[str, int | None, str]], unit: str, words: Words, r: random.Random) -> float:
    """Of the closed texts at the limits, the share that is cut there: as many as chance leaves closed.

    Cuts of the good texts at random places tell how often that is. Where no closed text stands at a limit, 1."""
    left = Counter(closed(t[: r.randint(20, len(t) - 1)], words) for t, _, _ in good for _ in range(2) if len(t) > 40)
    seen = Counter(closed(t, words) for t, _, a in rows if a == unit and not MARKS.search(t.rstrip()))
    return min(1.0, seen[False] * left[True] / max(1, left[False]) / seen[True]) if seen[True] else 1.0


def train(rows: list[tuple[str, int | None, str]], seed: int = 17) -> Model:
    """The model of (text, declared length, standing to the limit) rows."""
    r = random.Random(seed)
    rows = [judged(*x) for x in rows]
    words = Words([t for t, _, _ in rows])
    good = [(t, d, a) for t, d, a in rows if intact(t, d, a, words)]
    x = [features(t, d, a, words) for t, d, a in good]
    y = [0.0] * len(x)
    shut = [(t, d) for t, d, _ in good if closed(t, words)]
    for unit in ("chars", "bytes"):
        share = chance(rows, good, unit, words, r)
        for t, d in shut[::12]:  # a cut at the limit may fall on any end
            x.append(features(t, d, unit, words))
            y.append(share)
    for t, _, _ in good * 2:
        if len(t) > 40:
            c = cut_at_random(r, t)
            limit = r.random() < LIMITED
            kind, line = end_line(c)
            shown = kind in ("fence", "table", "link", "omitted", "cite", "name", "caption") or kind == "item" and words.last(c.rstrip()) == "word" or words.lines[_DIGIT.sub("0", line).strip()]
            if not MARKS.search(c.rstrip()) and (closed(c, words) if limit else _WHOLE.search(c) or shown):
                continue  # nothing shows that it was cut, or chance has told
            x.append(features(c, len(t) if r.random() < 0.15 else len(c), ("chars" if r.random() < 0.5 else "bytes") if limit else "no", words))
            y.append(1.0)
    w, g2 = np.zeros(BUCKETS + 1, np.float64), np.full(BUCKETS + 1, 1e-6)
    if not x or 1.0 not in y:
        w[-1] = -30.0  # nothing to learn from: nothing is called cut
        return Model(words, w)
    xs, ys = np.array(x), np.array(y)
    xs = np.concatenate([xs, np.full((len(xs), 1), BUCKETS)], 1)
    order = np.random.default_rng(seed)
    for _ in range(12):
        for part in np.array_split(order.permutation(len(xs)), max(1, len(xs) // 64)):
            p = 1 / (1 + np.exp(-np.clip(w[xs[part]].sum(1), -30, 30)))
            e = (p - ys[part])[:, None].repeat(xs.shape[1], 1)
            g = np.bincount(xs[part].ravel(), e.ravel(), BUCKETS + 1) / len(part) + 1e-6 * w
            g2 += g * g
            w -= 0.15 * g / np.sqrt(g2)
    return Model(words, w)


def limits(df: DataFrame) -> DataFrame:
    """(source, unit, most) of the sources with a limit, from rows of (source, text): one row per source at most."""
    sized = df.where(F.col("source").isNotNull() & (F.length("text") > 0)).select("source", F.xxhash64("text").alias("h"), F.length("text").alias("chars"), F.octet_length("text").alias("bytes"))
    long = sized.select("source", "h", F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("n")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("n")))).alias("u"))
    counts = long.select("source", "h", "u.*").distinct().groupBy("source", "unit", "n").agg(F.count(F.lit(1)).alias("c"))
    # a row per source and length: bounded by the lengths there are, whatever the number of texts
    by = Window.partitionBy("source", "unit").orderBy("n")
    near = F.when(F.col("unit") == "bytes", F.sum("c").over(by.rangeBetween(-3, 0))).otherwise(F.col("c"))
    got = counts.select("*", near.alias("at"), F.sum("c").over(by.rangeBetween(1, Window.unboundedFollowing)).alias("above"), F.sum("c").over(by.rangeBetween(-60, -5)).alias("below"))
    got = got.where((F.col("n") >= LEAST_LIMIT) & (F.col("at") >= 4) & (F.coalesce("above", F.lit(0)) * 4 <= F.col("at")) & (F.col("at") * 12 >= F.coalesce("below", F.lit(0)) * 4))
    return got.groupBy("source").agg(F.max_by(F.struct("unit", F.col("n").alias("most")), F.struct("at", F.col("unit") == "chars", "n")).alias("u")).select("source", "u.*")


def standing(df: DataFrame, lim: DataFrame) -> DataFrame:
    """df with at_limit: chars, bytes or no."""
    chars, size = (F.col("unit") == "chars") & (F.length("text") == F.col("most")), (F.col("unit") == "bytes") & F.octet_length("text").between(F.col("most") - 3, F.col("most"))
    at = F.when(chars, "chars").when(size, "bytes").otherwise("no")
    # the table of limits has one row per source; the join is left to the planner, which sees its size
    return df.join(lim, "source", "left").withColumn("at_limit", at).drop("unit", "most")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, score) of every text."""
    df = read(spark, sf_dir, "documents", "doc_id", "source", "text", "n_chars")
    lim = limits(df)
    rows = [(r["text"], r["n_chars"], r["at_limit"]) for r in standing(hashed_sample(df.where(F.length("text").between(1, SAMPLE_CHARS)), "doc_id", SAMPLE), lim).toArrow().to_pylist()]
    model = train([(t, None if d is None else int(d), a) for t, d, a in sorted(rows, key=lambda r: (r[0], str(r[1])))])

    def run(b: pa.RecordBatch) -> dict:
        ids, sources, texts, declared, at = (c.to_pylist() for c in b.columns)
        return {"doc_id": ids, "source": sources, "score": [model.score(t, None if d is None else int(d), a) if t and t.strip() else 0.0 for t, d, a in zip(texts, declared, at, strict=True)]}

    whole = standing(spread(df), lim).select("doc_id", "source", "text", "n_chars", "at_limit")
    return arrow_map(whole, run, "doc_id bigint, source string, score double")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text was cut."""
    return scored(spark, sf_dir).where(F.col("score") >= 0.5).select("doc_id").distinct()


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, texts, cut, rate): how often each source cuts; repeated ids count once."""
    one = scored(spark, sf_dir).groupBy("doc_id", "source").agg(F.max("score").alias("score"))
    by = one.groupBy("source").agg(F.count(F.lit(1)).alias("texts"), F.sum((F.col("score") >= 0.5).cast("bigint")).alias("cut"))
    return by.withColumn("rate", F.col("cut") / F.col("texts"))
