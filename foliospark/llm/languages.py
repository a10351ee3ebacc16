"""Problem 5: the language of documents and of stretches of text, with a confidence.

Multinomial logistic regression on TF-IDF weights of hashed character n-grams (1 to 4, within words), trained by
follow-the-regularised-leader with an elastic net, then calibrated by a temperature on held-out stretches. Labels are those of
a bounded hash sample (SAMPLE) of the corpus, with one fixed sentence per language; stretches that a first model
contradicts with confidence are taken for wrongly labelled and left out of the second.
The weights of a stretch are normalised to a sum of one, so its score is the sum of its words' scores over the sum of
their weights: each worker scores a word once and adds up. A stretch is a sentence or a line; one with few letters or an
unsure score takes the language of its text.

Defined results: null, empty and letterless texts have no language and give no row; documents without paragraphs give none;
a label that is null, empty or names no language counts as missing; ties go to the first code in the order of LANGS.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, durable, hashed_sample, read, spread
from .lookalikes import canonical
from .sentences import _CYRILLIC_ONLY, _DROP, _TO_CYRILLIC

SAMPLE = 3000  #: documents whose labels are learned from
STRETCHES = 8  #: of each of them, at most
SAMPLE_CHARS = 6000  #: of each of them, in training only, so that what reaches the driver is bounded
BUCKETS = 1 << 15
LANGS = ("en", "ko", "ja", "zh", "de", "fr", "es", "pt", "ru", "th", "ar", "hi")
#: Spellings of language labels: codes of ISO 639-1, 639-2 and 639-3, English and own names.
SPELLINGS = {
    "en": "en eng english", "ko": "ko kor korean kr 한국어 조선말", "ja": "ja jpn japanese jp 日本語", "zh": "zh zho chi cmn chinese mandarin cn 中文 汉语 漢語",
    "de": "de deu ger german deutsch", "fr": "fr fra fre french français francais", "es": "es spa spanish castilian español espanol castellano",
    "pt": "pt por portuguese português portugues", "ru": "ru rus russian русский", "th": "th tha thai ไทย ภาษาไทย",
    "ar": "ar ara arb arabic العربية عربي", "hi": "hi hin hindi हिन्दी हिंदी",
}
#: One sentence of each language, so that each has a case even where the sample holds none.
SEEDS = {
    "en": "All people are born free and have the same rights, and they should act towards one another with reason.",
    "ko": "모든 사람은 자유롭게 태어나며 같은 권리를 가지고 서로 이성적으로 대해야 한다.",
    "ja": "すべての人は自由に生まれ、同じ権利を持ち、互いに理性をもって行動しなければならない。",
    "zh": "人人生而自由，享有同样的权利，并应以理性相互对待。",
    "de": "Alle Menschen werden frei geboren und haben gleiche Rechte, und sie sollen einander mit Vernunft begegnen.",
    "fr": "Tous les hommes naissent libres et ont les mêmes droits, et ils doivent agir avec raison les uns envers les autres.",
    "es": "Todas las personas nacen libres y tienen los mismos derechos, y deben comportarse con razón las unas con las otras.",
    "pt": "Todas as pessoas nascem livres e têm os mesmos direitos, e devem agir com razão umas para com as outras.",
    "ru": "Все люди рождаются свободными и имеют одинаковые права, и они должны поступать разумно друг с другом.",
    "th": "ทุกคนเกิดมาอย่างอิสระและมีสิทธิเท่าเทียมกันและควรปฏิบัติต่อกันด้วยเหตุผล",
    "ar": "يولد جميع الناس أحرارا ولهم الحقوق نفسها وعليهم أن يعامل بعضهم بعضا بالعقل.",
    "hi": "सभी लोग स्वतंत्र जन्म लेते हैं और उनके अधिकार समान हैं, और उन्हें एक दूसरे से विवेक से व्यवहार करना चाहिए।",
}

_UNSPACED = "ぁ-ヿ㐀-鿿豈-﫿ｦ-ﾟ"
_JOIN = "̀-ͯؐ-ًؚ-ٟऀ-ॣ​-‏⁠­﻿"
_TOKEN = re.compile(rf"[{_UNSPACED}]{{1,2}}|[ก-๎]{{1,4}}|(?:[^\W\d_{_UNSPACED}฀-๿]|[{_JOIN}])+")
_STOP = re.compile(r"(?<=[.!?。！？।؟…])[\"”»’」』)\]]*(?:\s+|(?<=[。！？]))")
_END = re.compile(r"[.!?。！？।؟…．｡॥][\"'”»’」』)\]）​-‏⁠﻿\s]*$")
_CODE = re.compile(r"^[ \t]*(`{3,}|~{3,}).*?(?:^[ \t]*\1[`~]*[ \t]*$|\Z)", re.M | re.S)
_URL = re.compile(r"https?://\S+|www\.\S+")
#: A line that is no running text: contents, page numbers, bibliography, captions, headings and tables of plain text.
_ASIDE = re.compile(
    r"^\s*(?:#+\s|\||>?\s*\[\d+\]|[\[(]?\w[\w\s.-]*,\s*\d{4}[\])]?\s*$|—\s)"
    r"|[.·…]{4,}\s*\d+\s*$|(?:\bRep\.|\bpp\.|\bProc\.|\bPress\b|\bJ\.)[^\n]*\d{4}[a-z]?\)?\.?\s*$"
    r"|^\W*(?:(?:p|page|pág|seite|стр|S)\.?\s*)?\d+\s*(?:/|of|von|de|из)?\s*\d*\W*$|^\d*\s*[^.!?]{1,60}(?:\s\|\s[^.!?]{1,60}|\s·\s(?:19|20)\d\d)\s*\d*\.?\s*$",
    re.I,
)
_CAPTION = re.compile(r"^\s*(?:fig(?:ure|ura|\.)?|table|tab(?:la|ela|leau|elle|\.)?|abb(?:ildung|\.)?|рис(?:унок|\.)?|табл(?:ица|\.)?|그림|표|図|表|图|รูปที่|ตารางที่|الشكل|الجدول|चित्र|तालिका)\s*[\d٠-٩]+(?:-\d+)?[.:：]?\s+\S", re.I)


def label_language(label: Column) -> Column:
    """The code of a label in any common spelling; null where it names no language."""
    words = F.split(F.lower(F.trim(label)), r"[-_ ,;(]")
    known = {s: lang for lang, x in SPELLINGS.items() for s in x.split()}
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    return table[words[0]]


def _plain(word: str) -> str:
    """A word in small letters of one script."""
    if word.isascii():
        return word.lower()
    word = word.translate(_DROP)
    return (word.translate(_TO_CYRILLIC) if _CYRILLIC_ONLY.search(word) else canonical(word)).lower()


def grams(word: str) -> np.ndarray:
    """Buckets of the character n-grams of a word, 1 to 4 characters, with its edges."""
    c = np.frombuffer((f" {_plain(word)} ").encode("utf-32-le"), np.uint32).astype(np.uint64)
    out, h = [], np.zeros(len(c), np.uint64)
    for n in range(1, 5):
        if len(c) < n:
            break
        h = h[: len(c) - n + 1] * np.uint64(1_000_003) + c[n - 1 :] + np.uint64(n)
        out.append((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49))
    return np.concatenate(out).astype(np.int64)


class Model:
    """Weights of the n-grams, and the words scored so far in this process."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray, idf: np.ndarray, temperature: float):
        self.weights, self.bias, self.idf, self.temperature = weights, bias, idf, temperature
        self._reset()

    def _reset(self):
        self.ids: dict[str, int] = {}
        self.rows = np.zeros((1024, len(LANGS) + 2), np.float32)

    def __getstate__(self):
        return self.weights, self.bias, self.idf, self.temperature

    def __setstate__(self, s):
        self.__init__(*s)

    def word(self, w: str) -> int:
        """The row of a word: scores of its languages, sum of its weights, its letters."""
        i = self.ids.get(w)
        if i is None:
            i = self.ids[w] = len(self.ids)
            if i == len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            g = grams(w)
            v = self.idf[g]
            self.rows[i, :-2] = v @ self.weights[g]
            self.rows[i, -2] = v.sum()
            self.rows[i, -1] = sum(c.isalpha() for c in w)
        return i

    def score(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(probabilities of the languages, letters) of each stretch."""
        if len(self.ids) > 400_000:  # memory only: scores don't depend on it
            self._reset()
        word, at, flat = self.word, [0], []
        get = self.ids.get
        for s in stretches:
            flat += [i if (i := get(w)) is not None else word(w) for w in _TOKEN.findall(s)]
            at.append(len(flat))
        if not flat:
            return np.full((len(stretches), len(LANGS)), 1 / len(LANGS), np.float32), np.zeros(len(stretches), np.int64)
        total = np.concatenate([np.zeros((1, len(LANGS) + 2)), np.cumsum(self.rows[np.array(flat)], 0, dtype=np.float64)])
        got = np.diff(total[np.array(at)], axis=0)
        z = (SCALE * got[:, :-2] / np.maximum(got[:, -2:-1], 1e-6) + self.bias) / self.temperature
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True), got[:, -1].astype(np.int64)


SCALE = 12.0  #: of normalised feature vectors
ALPHA, BETA, L1, L2 = 0.5, 1.0, 2e-3, 1e-3  #: of follow-the-regularised-leader


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 3, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial weights by FTRL-proximal with elastic net, in small batches."""
    k = len(LANGS)
    z, n = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))
    r = np.random.default_rng(seed)

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= L1, 0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(epochs):
        for part in np.array_split(r.permutation(len(rows)), max(1, len(rows) // 32)):
            idx = np.concatenate([np.append(rows[i][0], BUCKETS) for i in part])
            val = np.concatenate([np.append(rows[i][1], 1.0) for i in part])
            of = np.repeat(np.arange(len(part)), [len(rows[i][0]) + 1 for i in part])
            u, inv = np.unique(idx, return_inverse=True)
            w = weights(u)
            s = np.zeros((len(part), k))
            np.add.at(s, of, w[inv] * val[:, None])
            e = np.exp(s - s.max(1, keepdims=True))
            p = e / e.sum(1, keepdims=True)
            p[np.arange(len(part)), y[part]] -= 1
            g = np.zeros((len(u), k))
            np.add.at(g, inv, p[of] * val[:, None])
            sigma = (np.sqrt(n[u] + g * g) - np.sqrt(n[u])) / ALPHA
            z[u] += g - sigma * w
            n[u] += g * g
    w = weights(slice(None))
    return w[:BUCKETS].astype(np.float32), w[BUCKETS].astype(np.float32)


def train(labelled: list[tuple[str, str]]) -> Model:
    """The model of (stretch, language) cases."""
    cases = [(t, LANGS.index(lang)) for t, lang in labelled if len(_TOKEN.findall(t)) > 2] + [(t, LANGS.index(lang)) for lang, t in SEEDS.items()] * 2
    feats = [np.unique(np.concatenate([grams(w) for w in _TOKEN.findall(t)]), return_counts=True) for t, _ in cases]
    y = np.array([c for _, c in cases])
    df = np.zeros(BUCKETS)
    for i, _ in feats:
        df[i] += 1
    idf = (np.log((1 + len(cases)) / (1 + df)) + 0.2).astype(np.float32)
    rows = [(i, SCALE * c * idf[i] / (c * idf[i]).sum()) for i, c in feats]
    held = np.arange(len(cases)) % 5 == 0

    def fit(keep):
        return ftrl([rows[i] for i in keep], y[keep])

    def logits(w, b, which):
        return np.array([rows[i][1] @ w[rows[i][0]] + b for i in which])

    every = np.arange(len(cases))
    w, b = fit(every)
    s = logits(w, b, every)
    p = np.exp(s - s.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    keep = every[~((p[every, y] < 0.1) & (p.max(1) > 0.7))]
    w, b = fit(keep[~held[keep]])
    kept = keep[held[keep]]
    s, t = logits(w, b, kept), 1.0
    if len(kept) > 20:  # the temperature of least loss on held-out stretches
        grid = np.exp(np.linspace(np.log(0.2), np.log(3), 40))
        loss = [-(s[np.arange(len(kept)), y[kept]] / g - np.log(np.exp(s / g - (s / g).max(1, keepdims=True)).sum(1)) - (s / g).max(1)).mean() for g in grid]
        t = float(grid[int(np.argmin(loss))])
    w, b = fit(keep)
    return Model(w, b, idf, t)


def fitted(spark: SparkSession, sf_dir: str) -> Model:
    """The model of the labelled documents of a hash sample, at most STRETCHES of each, chosen by even steps."""
    df = read(spark, sf_dir, "documents", "doc_id", "text", "lang").withColumn("lang", label_language(F.col("lang"))).where(F.col("lang").isNotNull() & (F.length("text") > 40))
    cases = []
    for r in hashed_sample(df.select("doc_id", F.substring("text", 1, SAMPLE_CHARS).alias("text"), "lang"), "doc_id", SAMPLE).toArrow().to_pylist():
        st = [s for s, e in stretches(r["text"], corpus=True) if e and len(s) > 12]
        cases += [(s[:400], r["lang"]) for s in st[:: max(1, -(-len(st) // STRETCHES))]]
    return train(cases)


def stretches(text: str, corpus: bool = False) -> list[tuple[str, bool]]:
    """(stretch, whether it is running text) of a text: its sentences or lines."""
    if corpus:
        text = _URL.sub(" ", _CODE.sub("\n", text) if "```" in text or "~~~" in text else text)
    out = []
    lines: list[str] = []
    for line in text.split("\n"):
        if not line or line.isspace():
            lines.append("")
        elif _ASIDE.search(line) or corpus and _CAPTION.search(line) and not _END.search(line):
            out.append((line, False))
        elif not corpus and lines and lines[-1]:  # a wrapped line goes on
            last = lines[-1]
            lines[-1] = last[:-1] + line.lstrip() if last[-1] == "-" and last[-2:-1].isalpha() else f"{last}\n{line}"
        else:
            lines.append(line)
    for line in lines:
        if not line:
            continue
        parts = [p for p in _STOP.split(line) if p and not p.isspace()]
        done = bool(_END.search(line)) or len(parts) > 1
        out += [(p, True if k < len(parts) - 1 else done or not corpus or len(p) > (25 if "ก" <= p[-1] <= "๛" or "ก" <= p[0] <= "๛" else 60)) for k, p in enumerate(parts)]
    return out


LEAST_LETTERS, SURE = 10, 0.7


def judge(texts: list[str], model: Model, corpus: bool = False) -> list[dict]:
    """Of each text: its running stretches' letters, sentences and confidence by language, and all its letters."""
    flat, where = [], []
    for k, t in enumerate(texts):
        st = stretches(t, corpus)
        if corpus and not any(run for _, run in st):
            st = [(s, True) for s, _ in st]
        for s, run in st:
            flat.append(s)
            where.append((k, run))
    p, letters = model.score(flat)
    out: list[dict] = [{"langs": {}, "letters": 0, "aside": 0} for _ in texts]
    i = 0
    best, top = p.argmax(1), p.max(1)
    while i < len(flat):
        k = where[i][0]
        j = i
        while j < len(flat) and where[j][0] == k:
            j += 1
        run = [q for q in range(i, j) if where[q][1] and letters[q]]
        out[k]["letters"] = int(letters[i:j].sum())
        out[k]["aside"] = int(sum(letters[q] for q in range(i, j) if not where[q][1]))
        if run:
            whole = (np.log(p[run] + 1e-9) * letters[run][:, None]).sum(0) if len({int(best[q]) for q in run}) > 1 else None
            main = int(best[run[0]]) if whole is None else int(np.bincount(best[run], letters[run], len(LANGS)).argmax())
            langs: dict = {}
            for q in run:
                sure = letters[q] >= LEAST_LETTERS and top[q] >= SURE
                lang = int(best[q]) if sure else main
                a = langs.setdefault(LANGS[lang], [0, 0, 0.0])
                a[0] += int(letters[q])
                a[1] += bool(sure)
                a[2] += float(p[q, lang]) * int(letters[q])
            out[k]["langs"] = langs
        i = j
    return out


def _spoken(df: DataFrame, keys: list[str], text: str, model: Model, corpus: bool) -> DataFrame:
    """keys, letters, ends, langs array<struct<lang, letters, sentences, confidence>> of each text."""
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(b: pa.RecordBatch) -> dict:
        texts = b.column(b.num_columns - 1).to_pylist()
        got = judge(texts, model, corpus)
        langs = [[{"lang": x, "letters": n, "sentences": m, "confidence": c / max(1, n)} for x, (n, m, c) in g["langs"].items()] for g in got]
        return {k: b.column(i) for i, k in enumerate(keys)} | {"letters": [g["letters"] for g in got], "ends": [bool(_END.search(t)) for t in texts], "langs": langs}

    schema = f"{kinds}, letters bigint, ends boolean, langs array<struct<lang: string, letters: bigint, sentences: bigint, confidence: double>>"
    return arrow_map(spread(df.where(F.length(text) > 0)).select(*keys, text), run, schema)


def _first(langs: str) -> Column:
    """The language with most letters; of equals, the first of LANGS."""
    rank = F.create_map(*[x for i, c in enumerate(LANGS) for x in (F.lit(c), F.lit(-i))])
    return F.array_max(F.transform(langs, lambda x: F.struct(x["letters"].alias("letters"), rank[x["lang"]].alias("rank"), x["lang"].alias("lang"), x["confidence"].alias("confidence"))))


def paragraphs(spark: SparkSession, sf_dir: str, model: Model) -> DataFrame:
    """What each paragraph is written in; repeated rows once."""
    df = read(spark, sf_dir, "odl_paragraphs", "para_id", "document_id", "kind", "text")
    return durable(_spoken(df, ["para_id", "document_id", "kind"], "text", model, False).dropDuplicates(["para_id", "document_id", "letters"]))


def document_languages(spoken: DataFrame) -> DataFrame:
    """(document_id, lang, confidence) of the documents of paragraphs()."""
    by = spoken.where(F.col("document_id").isNotNull()).select("document_id", F.inline("langs")).groupBy("document_id", "lang")
    sums = by.agg(F.sum("letters").alias("letters"), F.sum(F.col("letters") * F.col("confidence")).alias("c"))
    langs = sums.groupBy("document_id").agg(F.collect_list(F.struct("lang", "letters", (F.col("c") / F.col("letters")).alias("confidence"))).alias("langs"), F.sum("letters").alias("n"))
    return langs.withColumn("top", _first("langs")).select("document_id", F.col("top.lang").alias("lang"), (F.col("top.confidence") * F.col("top.letters") / F.col("n")).alias("confidence"))


def corpus_languages(spark: SparkSession, sf_dir: str, model: Model) -> DataFrame:
    """(doc_id, declared, lang, confidence) of the corpus texts with at least 40 letters."""
    df = read(spark, sf_dir, "documents", "doc_id", "lang", "text")
    got = _spoken(df.withColumnRenamed("lang", "declared"), ["doc_id", "declared"], "text", model, True).where((F.col("letters") >= 40) & (F.size("langs") > 0))
    return got.withColumn("top", _first("langs")).select("doc_id", "declared", F.col("top.lang").alias("lang"), F.col("top.confidence").alias("confidence"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing and wrong labels, foreign paragraphs and mixed paragraphs."""
    model = fitted(spark, sf_dir)
    spoken = paragraphs(spark, sf_dir, model)
    main = document_languages(spoken)
    declared = read(spark, sf_dir, "docmeta", "document_id", "declared_lang").distinct()
    wrong = lambda label: F.coalesce(label_language(F.col(label)) != F.col("lang"), F.lit(True))
    document = declared.join(main, "document_id").where(wrong("declared_lang")).select(F.lit("document").alias("rec"), F.col("document_id").alias("rec_key"), "lang")
    corpus = corpus_languages(spark, sf_dir, model).where(wrong("declared")).select(F.lit("corpus").alias("rec"), F.col("doc_id").cast("string").alias("rec_key"), "lang")
    running = spoken.where(F.col("kind").isin("paragraph", "text block") & (F.size("langs") > 0))
    one = running.where((F.size("langs") == 1) & (F.col("langs")[0]["letters"] >= 25) & (F.col("langs")[0]["sentences"] > 0) & (F.col("ends") | (F.col("langs")[0]["lang"] == "th")))
    foreign = one.select("para_id", "document_id", F.col("langs")[0]["lang"].alias("own")).join(main, "document_id").where(F.col("own") != F.col("lang"))
    foreign = foreign.select(F.lit("paragraph").alias("rec"), F.col("para_id").cast("string").alias("rec_key"), F.col("own").alias("lang"))
    mixed = running.select("para_id", F.filter("langs", lambda x: x["sentences"] > 0).alias("langs")).where(F.size("langs") > 1)
    mixed = mixed.select(F.lit("mixed").alias("rec"), F.col("para_id").cast("string").alias("rec_key"), F.explode("langs.lang").alias("lang"))
    return document.union(corpus).union(foreign).union(mixed).distinct()


def p5_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec, rec_key, lang, confidence): the main language of every document and corpus text and each language of a paragraph."""
    model = fitted(spark, sf_dir)
    spoken = paragraphs(spark, sf_dir, model)
    d = document_languages(spoken).select(F.lit("document").alias("rec"), F.col("document_id").alias("rec_key"), "lang", "confidence")
    c = corpus_languages(spark, sf_dir, model).select(F.lit("corpus").alias("rec"), F.col("doc_id").cast("string").alias("rec_key"), "lang", "confidence")
    p = spoken.select("para_id", F.inline("langs")).select(F.lit("paragraph").alias("rec"), F.col("para_id").cast("string").alias("rec_key"), "lang", "confidence")
    return d.union(c).union(p).distinct()
