"""Problem 6: noise of scanned pages: words broken across lines, misrecognised characters, running heads, page numbers.

A lexicon of all words of the three tables with their counts, and of the pairs of neighbours, is counted on the executors. A
symmetric-delete index over it gives the candidates of a word that isn't in it, or that a far more frequent one dominates;
edit distance weighted by confusion pairs of recognition, counts and the neighbours pick the repair. Of scripts without
spaces, character triples take the place of words. A broken word is joined if its whole is a likelier word than its
hyphenated form. Running heads are lines by form, or lines that equal a title of their document or recur on its pages.

Defined results: null, empty and blank texts need no repair; text in code, formulas, links and tags is left alone; headings,
dropped lines, contents lines and table rows hold no misreads; repeated rows give one result; texts are read whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from functools import cached_property

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, durable, read, spread
from .lookalikes import canonical

RECURS = 40  #: letters that a line which recurs may have and still be a running head
HELD = 400_000  #: pairs that a task counts before it hands them on
LEAST = 4  #: times a word must occur, at least, to be in the lexicon
#: The same as a share of all words and pairs; it bounds the lexicon by 1 / SHARE entries, whatever the corpus.
SHARE = 2e-6
RATIO, RATIO_DIGIT = 40, 12  #: how many times more frequent a repair must be; of words with digits inside

#: What is read, and what it may stand for.
CONFUSIONS = (
    ("c", "e"), ("b", "h"), ("0", "o"), ("1", "l"), ("5", "s"), ("9", "g"), ("6", "é"), ("8", "B"), ("5", "S"), ("0", "O"), ("1", "I"), ("6", "b"),
    ("F", "E"), ("rn", "m"), ("m", "rn"), ("cl", "d"), ("vv", "w"), ("ii", "ü"), ("h", "li"), ("VV", "W"), ("q", "g"), ("f", "t"), ("6", "ó"), ("l", "1"),
    ("틀", "를"), ("н", "и"), ("л", "п"), ("щ", "ш"), ("曰", "日"), ("永", "水"), ("日", "目"), ("目", "日"), ("ソ", "ン"), ("ン", "ソ"), ("ظ", "ط"), ("未", "末"), ("人", "入"), ("己", "已"), ("シ", "ツ"), ("ツ", "シ"), ("ロ", "口"), ("力", "カ"),
)
WEAK = {("q", "g"), ("f", "t")}  #: pairs that hold only with a neighbour of the repair
_BY = defaultdict(list)
for _a, _b in CONFUSIONS:
    _BY[_a].append(_b)

_CJK = "぀-ヿ㐀-鿿豈-﫿"
_W = re.compile(rf"(?:[^\W_{_CJK}฀-๿]|[̀-ًͯ-ٟऀ-ॣ])+(?:-(?:[^\W_{_CJK}฀-๿]|[̀-ًͯ-ٟऀ-ॣ])+)*")
_RUN = re.compile(rf"[{_CJK}]{{3,}}")
_MASK = re.compile(r"https?://\S+|`[^`\n]*`|\$[^$\n]*\$|\\\(.*?\\\)|</?[a-zA-Z!][^>\n]*>|&\w+;|\\\w+\*?(?:\{[^}\n]*\})?")
_NUMBER = re.compile(r"(?<![\w.,/])(?=[\d.,]*[OolISB])(?=[OolISB.,]*\d)[\dOolISB]+(?:[.,][\dOolISB]+)*(?![A-Za-z_\d])")
_HYPHEN = re.compile(r"((?:[^\W\d_]|[̀-ͯऀ-ॣ])[^\s\-]*)-\s*$")
_NEXT = re.compile(r"\s*((?:[^\W_]|[̀-ͯऀ-ॣ])+)")
_ROMAN = re.compile(r"^\W*(?=[ivxlc])(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})\W*$")
_FOLIO = re.compile(r"^\W*(?:(?:p|pp|page|pág|pag|seite|s|стр|с|หน้า|ص|पृ)\.?\s*)?\d{1,5}\s*(?:(?:/|of|von|de|из|sur|di)\s*\d{1,5})?\s*(?:쪽|页|頁|ページ|페이지)?\W*$", re.I)
_MARKUP = re.compile(r"^\s*(?:#|[-*+•·]\s|\|.*\||<|\\|={2,}|[`~]{3}|>|\d+[.)]\s|%|\$\$|\{\||!\s)")
_CONTENTS = re.compile(r"[.·…]{3,}\s*\d+\s*$|(?:\. ){3,}\d+\s*$")
_SENTENCE = re.compile(r"[.!?。！？।؟…:;,、，；]$")
_NO_HEAD = re.compile(r"[!?;=_{}]|\.\w")
_MARKED = re.compile(r"[`$\\<&]|://")
_NEAR_DIGIT = re.compile(r"[OolISB][.,]?\d|\d[.,]?[OolISB]")
_FOREIGN = re.compile(r"[Ͱ-ӿ‐-⁯！-￿]")
_TWINNED = re.compile(r"[Ͱ-Ͽ‐-⁯！-￿]|[A-Za-z][Ѐ-ӿ]|[Ѐ-ӿ][A-Za-z]|\b[Ѐ-ӿ]\b")
_RUSSIAN = re.compile(r"[бвгджзийклмнптфцчшщъыьэюя]{2}")
_ITEM = re.compile(r"\s*(?:[-*+•·]|\d+[.)])\s")
_NO_MAYBE = re.compile(r"[!?。！？।؟…:;,、，；]$|[.]{2,}$|-$")
_UNDERLINE = re.compile(r"\s{0,3}(?:={3,}|-{3,})\s*$")
_FENCE = re.compile(r"^\s*(`{3,}|~{3,})")
_FORM = re.compile(r"^\d{0,4}\s*[^|.!?]{1,40} \| [^|.!?]{1,90}\.?$|^[^|!?]{2,90} · (?:19|20)[\dOolI]{2}(?:\s+\d{1,4})?\.?$|^\d{1,4}\s{2,}[^|.!?]{2,90}\.?$|^[^|.!?]{2,90}\s{2,}\d{1,4}\.?$")


def is_head_form(line: str) -> bool:
    """Whether a line is a running head by its form alone."""
    s = line.strip()
    if len(s) > 120 or _MARKUP.match(s) or s[-1:].isdigit() and _CONTENTS.search(s):
        return False
    if (" | " in s or " · " in s or "  " in s) and _FORM.match(s):
        return True
    if not s.isupper() or _NO_HEAD.search(s):
        return False
    letters = [c for c in s if c.isalpha()]
    return len(letters) >= 5 and all(c.isupper() for c in letters)


def head_key(line: str) -> str:
    """What a running head and the title it repeats have in common, recognition noise set aside."""
    s = canonical(line.strip()).casefold()
    s = re.sub(r"^\d{1,4}\s{2,}|\s{2,}\d{1,4}\.?$", "", s)
    s = re.sub(r" · (?:19|20)\w\w\.?$|\.$", "", s)
    s = re.sub(r"^[^|]{1,40} \| ", "", s)
    s = s.replace("rn", "m").replace("vv", "w").replace("cl", "d").replace("ii", "ü").replace("li", "h")
    return re.sub(r"\W+", "", s.translate(str.maketrans("c01i598hf6日曰永틀", "eollsgbbee日日水를")))


def triples(text: str) -> list[str]:
    """The character triples of the runs without spaces of a text."""
    return [r[i : i + 3] for r in _RUN.findall(text) for i in range(len(r) - 2)]


def bare(token: str) -> str:
    """A token without digits before another script."""
    return token.lstrip("0123456789") if not token.isascii() and token[0].isdigit() else token


class Lexicon:
    """Words and pairs of neighbours with their counts."""

    def __init__(self, words: dict[str, int], pairs: dict[tuple[str, str], int]):
        self.words, self.pairs = words, pairs
        self.memo: dict = {}
        # words of the lexicon that are but misreads of far more frequent ones
        self.known = set(words) - {w for w in words if self._dominated(w)}

    def __getstate__(self):
        return self.words, self.pairs, self.known

    def __setstate__(self, s):
        self.words, self.pairs, self.known = s
        self.memo = {}

    @cached_property
    def index(self) -> dict[str, list[str]]:
        """Words by what is left of them with one character deleted."""
        out = defaultdict(list)
        for w in self.words:
            if len(w) > 1:
                for i in range(len(w)):
                    if not i or w[i] != w[i - 1]:
                        out[w[:i] + w[i + 1 :]].append(w)
        return dict(out)

    def _candidates(self, w: str) -> set[str]:
        """By symmetric deletes: up to two deleted of the word, one of the candidate; and by confusions of one for two."""
        seen = {w}
        for i in range(len(w)):
            a = w[:i] + w[i + 1 :]
            seen.add(a)
            if i + 1 < len(w) and w[i : i + 2] in _BY:
                seen.add(w[:i] + w[i + 2 :])
        out = {c for s in seen for c in self.index.get(s, ())}
        two = {w}
        for _ in range(2):  # two misreads in one word
            two |= {x[:i] + b + x[i + len(a) :] for x in two for a, bs in _BY.items() for i in range(len(x)) if x.startswith(a, i) for b in bs}
            if len(two) > 3000:
                break
        return (out | {x for x in two if x in self.words}) - {w}

    def _dominated(self, w: str) -> bool:
        return bool(len(w) > 2 and any(a in w for a in _BY) and not w.isdigit() and self._repair(w))

    def _repair(self, w: str) -> str | None:
        return self.repair(w, "", "")

    def repair(self, w: str, before: str, after: str) -> str | None:
        """The word that w is a misread of; None if it is none."""
        n = self.words.get(w, 0)
        digit = any(c.isdigit() for c in w)
        if w not in self.memo:
            found = []
            for c in self._candidates(w):
                m = self.words[c]
                if m < LEAST or m < (RATIO_DIGIT if digit else RATIO) * n or c.isdigit():
                    continue
                d = distance(w, c)
                if d[0] <= 0.9:
                    found.append((c, m, d))
            self.memo[w] = found
        best = None
        for c, m, (cost, weak) in self.memo[w]:
            near = self.pairs.get((before, c), 0) + self.pairs.get((c, after), 0)
            if weak and not near or not digit and not near and m < RATIO * 2 and len(w) < 6 and n:
                continue
            s = math.log(m) + 2 * math.log1p(near) - 6 * cost
            if best is None or (s, c) > best:
                best = (s, c)
        return best and best[1]


def distance(w: str, c: str) -> tuple[float, bool]:
    """(edit distance, whether it needs a weak pair): a confusion costs 0.4, any other edit 1."""
    a, b = len(w), len(c)
    cost = [[0.0] * (b + 1) for _ in range(a + 1)]
    weak = [[False] * (b + 1) for _ in range(a + 1)]
    for i in range(a + 1):
        for j in range(b + 1):
            if not i and not j:
                continue
            ways = []
            if i:
                ways.append((cost[i - 1][j] + 1, weak[i - 1][j]))
            if j:
                ways.append((cost[i][j - 1] + 1, weak[i][j - 1]))
            if i and j:
                ways.append((cost[i - 1][j - 1] + (w[i - 1] != c[j - 1]), weak[i - 1][j - 1]))
            for x in (1, 2):
                for y in (w[i - x : i],) if i >= x else ():
                    for z in _BY.get(y, ()):
                        if j >= len(z) and c[j - len(z) : j] == z:
                            ways.append((cost[i - x][j - len(z)] + 0.4, weak[i - x][j - len(z)] or (y, z) in WEAK))
            cost[i][j], weak[i][j] = min(ways)
    return cost[a][b], weak[a][b]


TEXTS = (("odl_paragraphs", "para_id", "text"), ("page_outcomes", "out_id", "markdown"), ("normalized_pages", "np_id", "markdown"))


def lexicon(spark: SparkSession, sf_dir: str) -> Lexicon:
    """The lexicon of all texts; only what passes the share reaches the driver."""

    def run(batches):
        words, pairs = Counter(), Counter()

        def out() -> pa.RecordBatch:
            n = [*words.values(), *pairs.values()]
            a = [*words, *(p[0] for p in pairs), ""]
            b = [*[None] * len(words), *(p[1] for p in pairs), ""]
            got = pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array([*n, sum(n)], pa.int64())], names=["a", "b", "n"])
            words.clear()
            pairs.clear()
            return got

        for batch in batches:
            for t in batch.column(0).to_pylist():
                ts = _W.findall(t)
                words.update(ts)
                pairs.update(zip(ts, ts[1:]))
                if not t.isascii():
                    words.update(triples(t))
                if len(pairs) > HELD:
                    yield out()
        yield out()

    parts = [spread(read(spark, sf_dir, t, c).where(F.length(c) > 0)).mapInArrow(run, "a string, b string, n bigint") for t, _, c in TEXTS]
    sums = durable(parts[0].union(parts[1]).union(parts[2]).groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST))
    total = sums.where(F.col("a") == "").agg(F.max("n")).first()[0] or 0
    kept = sums.where((F.col("n") >= max(LEAST, SHARE * total)) & (F.col("a") != "")).toArrow().to_pydict()
    words = {a: n for a, b, n in zip(kept["a"], kept["b"], kept["n"]) if b is None}
    return Lexicon(words, {(a, b): n for a, b, n in zip(kept["a"], kept["b"], kept["n"]) if b is not None})


def lines_of(text: str, heading: bool = False) -> list[tuple[str, str]]:
    """(line, role) of each line: code, blank, folio, head, maybe (a head if a title or a recurring line equals it), aside or run."""
    out: list[tuple[str, str]] = []
    fence = None
    raw = text.split("\n")
    top = True
    last = max((i for i, x in enumerate(raw) if x.strip()), default=-1)
    for i, line in enumerate(raw):
        s = line.strip()
        if m := _FENCE.match(line):
            fence = None if fence and m.group(1).startswith(fence) else fence or m.group(1)
            out.append((line, "code"))
            top = False
            continue
        if fence:
            out.append((line, "code"))
            continue
        if not s:
            out.append((line, "blank"))
            continue
        if heading:
            out.append((line, "aside"))
        elif _FOLIO.match(s) or _ROMAN.match(s) and (i == last or top):
            out.append((line, "folio"))
            top = True
            continue
        elif is_head_form(s):
            out.append((line, "head"))
            top = True
            continue
        elif i + 1 < len(raw) and _UNDERLINE.match(raw[i + 1]) or _MARKUP.match(s) and not _ITEM.match(line) or s[-1].isdigit() and _CONTENTS.search(s):
            out.append((line, "aside"))
        elif len(s) <= 90 and (top or i == last) and not _NO_MAYBE.search(s) and (not s.endswith(".") or len(s) < 70):
            out.append((line, "maybe"))
            if top:
                continue
        else:
            out.append((line, "run"))
        top = False
    return out


_CJK_DOUBT = re.compile("[" + "".join(sorted({a for a, _ in CONFUSIONS if len(a) == 1 and ord(a) > 0x3000})) + "]")


def quiet(text: str, lex: Lexicon) -> bool:
    """Whether a text surely needs nothing: one line of running text, all of whose words are known."""
    if "\n" in text or len(text) < 70 or not (len(text) > 120 or text[-1] in ".!?。！？।؟"):
        return False
    if "  " in text or " | " in text or " · " in text or text.isupper() or _NEAR_DIGIT.search(text) or not text.isascii() and (_CJK_DOUBT.search(text) or _FOREIGN.search(text) and _TWINNED.search(text)):
        return False
    known = lex.known
    return all(bare(w) in known or len(w) < 2 or w.isdigit() or not bare(w) for w in set(_W.findall(text)) - known)


def mend(text: str, lex: Lexicon, heading: bool = False) -> tuple[list[tuple[int, str]], list[tuple[int, str]], list[tuple[int, str, str]]]:
    """Of a text: ([(line, fix)], [(line, key of a line that may be a running head)], [(line, misread, repair)]).

    The key of a line that ends as a sentence does begins with a full stop."""
    fixes: list[tuple[int, str]] = []
    maybe: list[tuple[int, str]] = []
    single = "\n" not in text
    if single and (heading or len(text) > 120):
        ls = [(text, "aside" if heading else "run")] if text.strip() else []
    else:
        ls = lines_of(text, heading)
    run: list[tuple[int, str]] = []
    for no, (line, role) in enumerate(ls, 1):
        if role in ("folio", "head"):
            fixes.append((no, "drop"))
        elif role == "maybe":
            maybe.append((no, ("." if line.rstrip().endswith(".") else "") + head_key(line)))
        if role in ("run", "maybe"):
            run.append((no, line))
    words: list[tuple[str, list[int], int]] = []  # (word, lines of it, length of its first part)
    skip = 0
    repairs: list[tuple[int, str, str]] = []
    for k, (no, line) in enumerate(run):
        body = _MASK.sub(" ", line) if _MARKED.search(line) else line
        if skip:
            body = " " * skip + body[skip:]
            skip = 0
        if not body.isascii() and _FOREIGN.search(body) and _TWINNED.search(body) and not _RUSSIAN.search(body):
            body = canonical(body)
        for m in _NUMBER.finditer(body) if _NEAR_DIGIT.search(body) else ():
            good = m.group().translate(str.maketrans("OolISB", "001158"))
            if len(m.group()) > 2 or m.group() not in lex.words or lex.words.get(good, 0) >= RATIO_DIGIT * lex.words[m.group()]:
                if not re.fullmatch(r"[SBI]\d|\d[SBIlo]", m.group()) or lex.words.get(good, 0) >= RATIO * max(1, lex.words.get(m.group(), 0)):
                    repairs.append((no, m.group(), good))
        end = body.rstrip()
        tail = end.endswith("-") and _HYPHEN.search(end)
        got = _W.findall(body)
        if tail and k + 1 < len(run) and got:
            nxt = _NEXT.match(run[k + 1][1])
            first = got[-1]
            if nxt and not nxt.group(1)[0].isupper() and not nxt.group(1)[0].isdigit():
                rest = nxt.group(1)
                whole, parted = first + rest, f"{first}-{rest}"
                whole_n, parted_n = lex.words.get(whole, 0), lex.words.get(parted, 0)
                if not whole_n and not parted_n:
                    fixed, held = lex.repair(whole, "", ""), lex.repair(parted, "", "")
                    whole_n, parted_n = lex.words.get(fixed, 0), lex.words.get(held, 0)
                    if not whole_n and not parted_n and first in lex.known and rest in lex.known and min(lex.words[first], lex.words[rest]) > 20 * LEAST:
                        parted_n = 1
                if whole_n >= parted_n:
                    fixes.append((no, "join"))
                    words += [(w, [no], 0) for w in got[:-1]]
                    words.append((whole, [no, run[k + 1][0]], len(first)))
                else:
                    words += [(w, [no], 0) for w in got[:-1]]
                    words.append((parted, [no, run[k + 1][0]], len(first) + 1))
                skip = nxt.end()
                continue
        words += [(w, [no], 0) for w in got]
        for r in _RUN.findall(body) if not body.isascii() else ():
            for i, c in enumerate(r):
                for good in _BY.get(c, ()):
                    at = range(max(0, i - 2), min(i, len(r) - 3) + 1)
                    bad = min(lex.words.get(r[j : j + 3], 0) for j in at)
                    new = r[:i] + good + r[i + 1 :]
                    if min(lex.words.get(new[j : j + 3], 0) for j in at) >= max(LEAST, RATIO_DIGIT * bad):
                        repairs.append((no, r, new))
    known = lex.known
    for k, (w, where, cut) in enumerate(words):
        if w in known or len(w) < 2:
            continue
        w2 = bare(w)
        if not w2 or w2 in known or w2.isdigit() or len(w2) < 2:
            continue
        if "-" in w2 and all(p in known or len(p) < 2 or p.isdigit() for p in w2.split("-")):
            continue
        good = lex.repair(w2, words[k - 1][0] if k else "", words[k + 1][0] if k + 1 < len(words) else "")
        if not good and "-" in w2:
            bits = [(p, lex.repair(p, "", "")) for p in w2.split("-") if p not in known and len(p) > 1]
            if any(g for _, g in bits):
                good = "-".join(dict(bits).get(p) or p for p in w2.split("-"))
        if good:
            i = next((i for i, (x, y) in enumerate(zip(w2, good)) if x != y), min(len(w2), len(good)))
            repairs.append((where[-1] if cut and i >= cut else where[0], w2, good))
    fixes += [(no, "misread") for no in sorted({r[0] for r in repairs})]
    return fixes, maybe, repairs


def _fixes(spark: SparkSession, sf_dir: str, lex: Lexicon) -> DataFrame:
    """(rec, document_id, page_index, row_id, line_no, fix, key) of all texts; fix is null for lines that may be heads."""
    schema = "rec string, document_id string, page_index int, row_id bigint, line_no bigint, fix string, key string"
    out = None
    for table, key, col in TEXTS:
        # headings hold no line to mend
        body = ~F.coalesce(F.col("kind") == "heading", F.lit(False)) if table == "odl_paragraphs" else F.lit(True)

        def run(b: pa.RecordBatch, rec=table) -> dict:
            got: dict = {n: [] for n in ("rec", "document_id", "page_index", "row_id", "line_no", "fix", "key")}
            for d, p, i, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if quiet(t, lex):
                    continue
                fixes, maybe, _ = mend(t, lex)
                for no, fix, line in [*((n, f, None) for n, f in fixes), *((n, None, x) for n, x in maybe)]:
                    for name, v in zip(got, (rec, d, p, i, no, fix, line), strict=True):
                        got[name].append(v)
            return got

        df = read(spark, sf_dir, table).where((F.length(col) > 0) & body).select("document_id", "page_index", F.col(key).alias("i"), F.col(col).alias("t"))
        part = arrow_map(spread(df), run, schema)
        out = part if out is None else out.union(part)
    return durable(out.distinct())


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document_id, key) of the titles a document's running heads may repeat."""

    def run(b: pa.RecordBatch) -> dict:
        return {"document_id": b.column(0), "key": [head_key(t) for t in b.column(1).to_pylist()]}

    meta = read(spark, sf_dir, "docmeta", "document_id", "producer").select("document_id", F.col("producer")["title"].alias("t"))
    heads = read(spark, sf_dir, "odl_paragraphs", "document_id", "kind", "odl_level", "text").where((F.col("kind") == "heading") & (F.lower("odl_level") == "doctitle")).select("document_id", F.col("text").alias("t"))
    both = meta.union(heads).where(F.col("document_id").isNotNull() & (F.length("t") > 0)).distinct()
    return arrow_map(both, run, "document_id string, key string").where(F.length("key") > 0).distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line and fix."""
    got = _fixes(spark, sf_dir, lexicon(spark, sf_dir))
    maybe = got.where(F.col("fix").isNull() & F.col("document_id").isNotNull()).withColumn("dot", F.col("key").startswith("."))
    maybe = maybe.withColumn("key", F.regexp_replace("key", r"^\.", "")).where(F.length("key") > 0)
    # sentences recur too: only short lines of whole pages without a full stop count as recurring heads
    pages = maybe.where(~F.col("dot") & (F.col("rec") != "odl_paragraphs") & (F.length("key") <= RECURS)).groupBy("rec", "document_id", "key").agg(F.countDistinct("page_index").alias("pages")).where(F.col("pages") > 1)
    heads = pages.select("document_id", "key").union(titles(spark, sf_dir)).distinct()
    drop = maybe.join(heads, ["document_id", "key"], "left_semi").select("rec", "row_id", "line_no", F.lit("drop").alias("fix"))
    sure = got.where(F.col("fix").isNotNull()).select("rec", "row_id", "line_no", "fix")
    sure = sure.join(drop.select("rec", "row_id", "line_no").distinct(), ["rec", "row_id", "line_no"], "left_anti")
    return sure.union(drop).distinct()
