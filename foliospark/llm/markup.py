"""Problem 4: markup residue to clean text, with headings, lists, code, tables and formulas kept as such.

A page becomes a sequence of leaves (marks, lines, code regions, formulas, tables), each with its tag path. A bidirectional
LSTM in numpy reads tag path and hashed words of the whole sequence and labels every leaf with the page in view, so that
"# x" is an item on a wiki page and a heading on a Markdown page. It is trained in each run on pages composed from texts of
a bounded hash sample (SAMPLE) of the pages, whose labels are known as they are made. An exact check follows: a leaf keeps
only a label that its mark can have.

Defined results: null, empty and blank pages give no element; unclosed regions reach the end of the page; repeated rows
give one result; texts of any length are read whole.
"""

from __future__ import annotations

import html
import random
import re
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, hashed_sample, read, spread

SAMPLE = 1200  #: pages of each table whose texts the training pages are made of
SAMPLE_CHARS = 2000  #: of each of them, in training only, so that what reaches the driver is bounded
TRAIN_PAGES = 1400
HIDDEN, WORDS, EPOCHS, BATCH = 16, 24, 5, 50
LABELS = ("text", "heading", "list_item", "code_block", "formula", "table", "table_row", "noise")
L = {x: i for i, x in enumerate(LABELS)}
#: What the exact check allows each mark to be.
MAY = {
    "comment": "noise", "texcomment": "noise", "nowiki": "text", "icode": "text", "tick": "text", "texttt": "text",
    "fence": "code_block", "pre": "code_block", "highlight": "code_block", "texcode": "code_block",
    "math_dd": "formula", "math_br": "formula", "math_env": "formula", "math_tag": "formula", "math_in": "formula", "math_dollar": "formula",
    "html_table": "table", "wiki_table": "table", "tex_table": "table", "pipe_table": "table", "row": "table_row",
    "h_html": "heading", "li_html": "list_item", "tex_head": "heading", "item": "list_item",
    "hash": "heading list_item", "hash_tight": "text list_item", "wiki_eq": "heading", "setext": "heading",
    "bullet": "list_item", "bullet_tight": "text list_item", "number": "list_item text",
    "quote": "text", "line": "text noise", "folio": "noise text",
}
ATOMS = {a: i for i, a in enumerate(MAY)}
_ALLOWED = np.array([[x in m.split() for x in LABELS] for m in MAY.values()])

_MASTER = re.compile(
    r"""
    (?P<comment><!--.*?(?:-->|\Z))
  | (?P<fence>^[ \t]*(?P<f>`{3,}|~{3,})[^\n`]*\n.*?(?:^[ \t]*(?P=f)[`~]*[ \t]*$|\Z))
  | (?P<pre><pre\b.*?(?:</pre\s*>|\Z))
  | (?P<highlight><(?P<hl>syntaxhighlight|source)\b.*?(?:</(?P=hl)\s*>|\Z))
  | (?P<texcode>\\begin\{(?P<te>lstlisting|verbatim|minted)\}.*?(?:\\end\{(?P=te)\}|\Z))
  | (?P<nowiki><nowiki>.*?(?:</nowiki>|$))
  | (?P<icode><code\b[^>]*>.*?</code\s*>)
  | (?P<texttt>\\(?:texttt|verb|lstinline)\{[^}\n]*\})
  | (?P<tick>(?<![`\\])(?P<t>`{1,2})(?!`)[^\n]+?(?<!`)(?P=t)(?!`))
  | (?P<texcomment>^[ \t]*%[^\n]*$)
  | (?P<html_table><table\b.*?(?:</table\s*>|\Z))
  | (?P<wiki_table>^\{\|.*?(?:^\|\}|\Z))
  | (?P<tex_table>\\begin\{(?P<tt>tabular[x*]?|longtable)\}.*?(?:\\end\{(?P=tt)\}|\Z))
  | (?P<math_dd>(?<!\\)\$\$.+?(?:\$\$|\Z))
  | (?P<math_br>(?<!\\)\\\[.+?(?:\\\]|\Z))
  | (?P<math_env>\\begin\{(?P<me>(?:equation|align|gather|eqnarray|multline|displaymath|math|flalign|alignat)\*?)\}.*?(?:\\end\{(?P=me)\}|\Z))
  | (?P<math_tag><math\b.*?(?:</math\s*>|\Z))
  | (?P<math_in>(?<!\\)\\\(.+?\\\))
  | (?P<math_dollar>(?<![\\$\w])\$(?=[^\s$])(?!\d[\d.,]*\s)[^$\n]*?(?<=[^\s\\])\$(?![\d\w]))
  | (?P<pipe_table>^[ \t]*\|[^\n]*\n[ \t]*\|?[ \t:|-]*-{2,}[ \t:|-]*(?:\n[ \t]*\|[^\n]*)*)
  | (?P<h_html><h[1-6]\b[^>]*>)
  | (?P<li_html><li\b[^>]*>)
  | (?P<tex_head>\\(?:part|chapter|(?:sub){0,2}section|(?:sub)?paragraph)\*?\{)
  | (?P<item>\\item\b)
  | (?P<setext>^[ \t]{0,3}(?![-*+#>|`~<=\s])[^\n]+\n[ \t]{0,3}(?:=+|-+)[ \t]*$)
  | (?P<wiki_eq>^(?P<w>={1,6})(?!=)(?=[^\n]*[^=\n](?P=w)[ \t]*$))
  | (?P<hash>^[ \t]*\#{1,6}(?=[ \t]+\S))
  | (?P<hash_tight>^\#{1,6}(?=[^\s\#]))
  | (?P<folio>^[ \t]*(?:[-—–~\[(]+[ \t]*\d{1,4}[ \t]*[-—–~\])]+|\d{1,4}(?:/\d{1,4})?|(?:p\.|Page|S\.)[ \t]*\d{1,4}(?:[ \t]+of[ \t]+\d{1,4})?)[ \t]*$)
  | (?P<bullet>^[ \t]*[-*+•▪◦‣]{1,4}(?=[ \t]+\S))
  | (?P<bullet_tight>^\*{1,3}(?=[^\s*])(?![^\n]*[^\s*]\*))
  | (?P<number>^[ \t]*(?:\(?\d{1,3}[.)]|\(?(?-i:[a-z])\))(?=[ \t]+\S))
  | (?P<quote>^[ \t]*>)
    """,
    re.X | re.M | re.S | re.I,
)
_INLINE_MATH = re.compile(r"(?P<math_in>(?<!\\)\\\(.+?\\\))|(?P<math_tag><math\b.*?</math\s*>)|(?P<math_dollar>(?<![\\$\w])\$(?=[^\s$])(?!\d[\d.,]*\s)[^$\n]*?(?<=[^\s\\])\$(?![\d\w]))", re.S | re.I)
_ROW = re.compile(r"<tr\b[^>]*>|<!--.*?-->", re.S | re.I)
_BLOCKS = re.compile(r"\n[ \t]*\n")
_WORD = re.compile(r"\w+")
_WIKI = re.compile(r"'''|''|\[\[|\{\{|\{\||<nowiki>|<ref|^=+[^=\n]+=+\s*$|<syntaxhighlight", re.M)
_MD = re.compile(r"\*\*|^```|^~~~|\]\(http|^\|[ :|-]+\|$|^\$\$|\\\[|^={3,}$|^-{3,}$", re.M)


@dataclass(slots=True)
class Leaf:
    start: int
    end: int
    atom: str


def leaves(text: str) -> list[Leaf]:
    """The leaves of a page in text order."""
    out, at = [], 0

    def plain(a: int, b: int):
        k = a
        while k < b:
            m = _BLOCKS.search(text, k, b)
            e = m.start() if m else b
            if text[k:e].strip():
                out.append(Leaf(k, e, "line"))
            k = m.end() if m else b

    for m in _MASTER.finditer(text):
        if m.start() < at:
            continue
        plain(at, m.start())
        atom = m.lastgroup  # the outermost group closes last
        out.append(Leaf(m.start(), m.end(), atom))
        if atom.endswith("_table"):
            out += [Leaf(x.start(), x.end(), x.lastgroup) for x in _INLINE_MATH.finditer(text, m.start(), m.end())]
        elif atom == "setext":
            out += [Leaf(x.start(), x.end(), x.lastgroup) for x in _INLINE_MATH.finditer(text, m.start(), m.end())]
        at = m.end()
    plain(at, len(text))
    return out


def table_leaves(tables: list[str | None]) -> list[Leaf]:
    """The rows of the tables of an array, one leaf each; rows in comments don't count."""
    return [Leaf(m.start(), m.end(), "row") for t in tables if t for m in _ROW.finditer(t) if t[m.start() + 1] != "!"]


# ---- features -------------------------------------------------------------------------------------------------

N_FLAGS = 12
DIM = len(ATOMS) + N_FLAGS + WORDS


def features(text: str, ls: list[Leaf]) -> np.ndarray:
    """Tag path, place and hashed words of each leaf."""
    x = np.zeros((len(ls), DIM), np.float32)
    wiki, md = min(3, len(_WIKI.findall(text))) / 3, min(3, len(_MD.findall(text))) / 3
    base = len(ATOMS)
    for k, leaf in enumerate(ls):
        row = x[k]
        row[ATOMS[leaf.atom]] = 1
        if leaf.atom == "row":
            continue
        s, e = leaf.start, leaf.end
        end = text.find("\n", e)
        line = text[e : e + 160 if end < 0 or end > e + 160 else end] if leaf.atom != "line" else text[s : s + 160]
        before = text[max(0, s - 2) : s]
        row[base] = before == "" or before == "\n\n"
        row[base + 1] = before[-1:] == "\n" and before != "\n\n"
        row[base + 2] = end < 0 or text[end + 1 : end + 2] in ("", "\n")
        row[base + 3] = k > 0 and ls[k - 1].atom == leaf.atom
        row[base + 4] = line.rstrip()[-1:] in ".!?。！？।…:"
        row[base + 5] = min(len(line), 160) / 160
        row[base + 6] = sum(c.isdigit() for c in line) / (len(line) + 1)
        row[base + 7] = wiki
        row[base + 8] = md
        row[base + 9] = len(line) - len(line.lstrip()) > 1
        row[base + 10] = text[s:e].count("#") / 4 + text[s:e].count("=") / 8 if e - s < 8 else 0
        row[base + 11] = text[s : s + 1] in " \t"
        ws = _WORD.findall(line)[:24]
        for w in ws:
            h = crc32(w.lower().encode())
            row[base + N_FLAGS + h % WORDS] += (1 if h & 0x10000 else -1) / (1 + len(ws)) ** 0.5
    return x


# ---- bidirectional LSTM ---------------------------------------------------------------------------------------


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BiLSTM:
    """Two LSTMs over the leaf sequence, one from each end, and a softmax over both states of a leaf."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {}
        for d in "fb":
            self.p["W" + d] = (r.standard_normal((DIM, 4 * HIDDEN)) * 0.15).astype(np.float32)
            self.p["U" + d] = (r.standard_normal((HIDDEN, 4 * HIDDEN)) * 0.15).astype(np.float32)
            b = np.zeros(4 * HIDDEN, np.float32)
            b[HIDDEN : 2 * HIDDEN] = 1
            self.p["b" + d] = b
        self.p["O"] = (r.standard_normal((2 * HIDDEN, len(LABELS))) * 0.15).astype(np.float32)
        self.p["c"] = np.zeros(len(LABELS), np.float32)

    def _run(self, x, mask, d, keep):
        """States (T, B, H) of one direction; a masked step keeps state."""
        t, b = mask.shape
        z = x @ self.p["W" + d] + self.p["b" + d]
        h, c = np.zeros((b, HIDDEN), np.float32), np.zeros((b, HIDDEN), np.float32)
        hs, mem = np.empty((t, b, HIDDEN), np.float32), []
        for k in range(t):
            a = z[k] + h @ self.p["U" + d]
            s = _sigmoid(a[:, : 3 * HIDDEN])
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
            g = np.tanh(a[:, 3 * HIDDEN :])
            m = mask[k][:, None]
            c2 = np.where(m, f * c + i * g, c)
            tc = np.tanh(c2)
            h2 = np.where(m, o * tc, h)
            if keep:
                mem.append((h, c, i, f, o, g, tc, m))
            h, c = h2, c2
            hs[k] = h
        return hs, mem

    def forward(self, x, mask, keep=False):
        hf, mf = self._run(x, mask, "f", keep)
        hb, mb = self._run(x[::-1], mask[::-1], "b", keep)
        h = np.concatenate([hf, hb[::-1]], 2)
        return h @ self.p["O"] + self.p["c"], h, mf, mb

    def _back(self, x, dh, mem, d, grad):
        u = self.p["U" + d]
        t = len(mem)
        dz = np.zeros((t, x.shape[1], 4 * HIDDEN), np.float32)
        nh = np.zeros((x.shape[1], HIDDEN), np.float32)
        nc = np.zeros_like(nh)
        for k in range(t - 1, -1, -1):
            h, c, i, f, o, g, tc, m = mem[k]
            g_h = nh + dh[k]
            gh = np.where(m, g_h, 0)
            gc = np.where(m, nc, 0) + gh * o * (1 - tc * tc)
            da = np.concatenate([gc * g * i * (1 - i), gc * c * f * (1 - f), gh * tc * o * (1 - o), gc * i * (1 - g * g)], 1)
            dz[k] = da
            grad["U" + d] += h.T @ da
            nh = da @ u.T + np.where(m, 0, g_h)
            nc = np.where(m, gc * f, nc)
        grad["W" + d] += np.tensordot(x, dz, ([0, 1], [0, 1]))
        grad["b" + d] += dz.sum((0, 1))

    def fit(self, seqs: list[np.ndarray], labels: list[np.ndarray], seed: int = 11) -> None:
        r = np.random.default_rng(seed)
        m1 = {k: np.zeros_like(v) for k, v in self.p.items()}
        m2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, order = 0, np.argsort([len(s) for s in seqs], kind="stable")
        cuts = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
        for _ in range(EPOCHS):
            for q in r.permutation(len(cuts)):
                x, mask = pad([seqs[i] for i in cuts[q]])
                y = np.zeros(mask.shape, np.int64)
                for j, i in enumerate(cuts[q]):
                    y[: len(labels[i]), j] = labels[i]
                logit, h, mf, mb = self.forward(x, mask, True)
                e = np.exp(logit - logit.max(2, keepdims=True))
                p = e / e.sum(2, keepdims=True)
                p[np.arange(p.shape[0])[:, None], np.arange(p.shape[1])[None], y] -= 1
                p *= mask[:, :, None] / mask.sum()
                grad = {k: np.zeros_like(v) for k, v in self.p.items()}
                grad["O"] += np.tensordot(h, p, ([0, 1], [0, 1]))
                grad["c"] += p.sum((0, 1))
                dh = p @ self.p["O"].T
                self._back(x, dh[:, :, :HIDDEN], mf, "f", grad)
                self._back(x[::-1], dh[::-1][:, :, HIDDEN:], mb, "b", grad)
                step += 1
                for k, g in grad.items():
                    m1[k] = 0.9 * m1[k] + 0.1 * g
                    m2[k] = 0.99 * m2[k] + 0.01 * g * g
                    self.p[k] -= 0.02 * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)

    def label(self, seqs: list[np.ndarray], atoms: list[np.ndarray]) -> list[np.ndarray]:
        """The best label each leaf may have."""
        out: list = [None] * len(seqs)
        order = np.argsort([len(s) for s in seqs], kind="stable")
        i = 0
        while i < len(order):
            j = i + 1
            while j < len(order) and (j - i) < 512 and (j - i + 1) * len(seqs[order[j]]) < 200_000:
                j += 1
            x, mask = pad([seqs[k] for k in order[i:j]])
            logit = self.forward(x, mask)[0]
            for c, k in enumerate(order[i:j]):
                n = len(seqs[k])
                out[k] = np.where(_ALLOWED[atoms[k]], logit[:n, c], -np.inf).argmax(1)
            i = j
        return out


def pad(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max(len(s) for s in seqs)
    x = np.zeros((t, len(seqs), DIM), np.float32)
    mask = np.zeros((t, len(seqs)), bool)
    for j, s in enumerate(seqs):
        x[: len(s), j] = s
        mask[: len(s), j] = True
    return x, mask


# ---- pages made for training ----------------------------------------------------------------------------------

#: Contents of code and formulas of the pages made for training.
CODE = ("x = 1\n# note\ny = f(x)", "for k in range(9):\n    print(k)", "- key: one\n- key: two", "== raw ==\n1. no\n$$ no $$", "#include <a.h>\nint v[3];\n* p = 0;", "SELECT a, b\nFROM t -- * x *\nWHERE a > 3;")
MATH = ("a^2 + b^2", r"\frac{x}{y}", r"\sum_{k} c_k", "F = m a", r"x_{1} - x_{2}", r"\sqrt{z}", r"\beta \ge 2", r"\int f(t) dt")


def make_page(r: random.Random, texts: list[str]) -> list[tuple[str, str]]:
    """(piece, label) of a page in one of several markups; the pieces joined are the page."""
    kind = r.choices(("md", "wiki", "html", "tex", "scan"), (4, 3, 2, 2, 2))[0]
    out: list[tuple[str, str]] = []
    say = lambda n=60: r.choice(texts)[: r.randint(12, n + 40)].strip() or "x"

    def line(s: str, label: str = "text"):
        out.append((s, label))

    def inline():
        """Running text with inline marks."""
        for _ in range(r.randint(1, 3)):
            line(say(120) + r.choice((". ", " ", "! ")))
            q = r.random()
            if q < 0.2:
                m = r.choice(MATH)
                line({"md": r.choice((f"${m}$", rf"\({m}\)")), "wiki": f"<math>{m}</math>", "html": rf"\({m}\)", "tex": r.choice((f"${m}$", rf"\({m}\)")), "scan": f"${m}$"}[kind], "formula")
            elif q < 0.4:
                line({"md": r.choice((f"`{say(10)}`", f"**{say(10)}**", r"(\*see)", r"\# no")), "wiki": r.choice(("'''b'''", "[[A|b]]", f"<nowiki>* {say(10)}</nowiki>", "{{cite|a|p=1}}")), "html": f"<code>{say(10)}</code>", "tex": rf"\texttt{{{say(10).replace('}', '')}}}", "scan": "($5 each, $9 in all)"}[kind])
            elif q < 0.5:
                line(r.choice((" ($4)", r" (from \$8 to \$63)", " ($5 each, $9 in all)")))
            line(" ")

    if kind == "scan":
        if r.random() < 0.7:
            line(say(24) + r.choice(("\n", "\n\n")))
        if r.random() < 0.6:
            line("#" * r.randint(1, 3) + " ", "heading")
            line(say(24) + "\n\n")
    for _ in range(r.randint(1, 9)):
        q = r.random()
        if q < 0.25 and kind != "scan":
            n = r.randint(1, 3)
            if kind == "md":
                if r.random() < 0.3:
                    t = "Q" + say(20).replace("\n", " ")
                    line(f"{t}\n{r.choice('=-') * max(4, len(t))}", "heading")
                else:
                    line("#" * n + " ", "heading")
                    line(say(30) + (" " + "#" * n if r.random() < 0.3 else ""))
            elif kind == "wiki":
                line("=" * (n + 1), "heading")
                line(r.choice(("", " ")) + say(30).replace("=", "") + " " + "=" * (n + 1))
            elif kind == "html":
                line(f"<h{n}{r.choice(('', ' class=a', ' id=' + chr(34) + 's' + chr(34)))}>", "heading")
                line(say(30) + f"</h{n}>")
            else:
                line("\\" + "sub" * (n - 1) + r.choice(("section{", "section*{")), "heading")
                line(say(30) + "}" + r.choice(("", r"\label{s}")))
        elif q < 0.45 and kind != "scan":
            mark = {"md": r.choice(("- ", "* ", "+ ", "1. ", "2. ", "1) ", "3) ")), "wiki": r.choice(("* ", "# ", "*", "#", "** ", "## "))}.get(kind, "")
            if kind == "html":
                line("<ul>")
            elif kind == "tex":
                line("\\begin{itemize}\n")
            for _ in range(r.randint(1, 5)):
                if kind in ("md", "wiki"):
                    m = mark if r.random() < 0.7 else (mark.strip() + " " if kind == "wiki" else "  " + mark)
                    line(m, "list_item")
                    line(say(70).lstrip("*# -").replace("\n", " ") + "\n")
                elif kind == "html":
                    line("<li>", "list_item")
                    line(say(70) + r.choice(("</li>", "")))
                else:
                    line("\\item", "list_item")
                    line(" " + say(70) + "\n")
            if kind == "html":
                line("</ul>")
            elif kind == "tex":
                line("\\end{itemize}")
        elif q < 0.55 and kind != "scan":
            c = r.choice(CODE)
            f = r.choice(("```", "~~~", "````"))
            line({"md": f"{f}{r.choice(('', 'py'))}\n{c}\n{f}", "html": f"<pre><code>{html.escape(c)}</code></pre>", "wiki": r.choice((f"<syntaxhighlight lang=\"c\">\n{c}\n</syntaxhighlight>", f"<pre>{c}</pre>")), "tex": f"\\begin{{verbatim}}\n{c}\n\\end{{verbatim}}"}[kind], "code_block")
        elif q < 0.65 and kind != "scan":
            m = r.choice(MATH)
            line({"md": r.choice((f"$$\n{m}\n$$", f"$${m}$$", rf"\[{m}\]")), "html": f"$${m}$$", "wiki": f"<math display=\"block\">{m}</math>", "tex": r.choice((rf"\[{m}\]", f"\\begin{{equation}}\n{m}\n\\end{{equation}}", f"\\begin{{align*}}\n{m}\n\\end{{align*}}"))}[kind], "formula")
        elif q < 0.73 and kind != "scan":
            n, rows = r.randint(2, 3), r.randint(1, 4)
            cells = lambda sep: sep.join(say(8).replace("|", "").replace("\n", " ").replace("$", "") for _ in range(n))
            if kind == "md":
                line("| " + cells(" | ") + " |\n|" + "---|" * n + "".join("\n| " + cells(" | ") + " |" for _ in range(rows)), "table")
            elif kind == "wiki":
                line("{| class=\"a\"\n! " + cells(" !! ") + "".join("\n|-\n| " + cells(" || ") for _ in range(rows)) + "\n|}", "table")
            elif kind == "tex":
                line("\\begin{tabular}{ll}\n" + "".join(cells(" & ") + " \\\\\n" for _ in range(rows)) + "\\end{tabular}", "table")
            else:
                line("<table>" + "".join("<tr><td>" + cells("</td><td>") + "</td></tr>" for _ in range(rows)) + "</table>", "table")
        elif q < 0.78:
            line(r.choice(("<!-- # draft\n- old -->", "<!-- <h2>Old</h2> -->")) if kind != "tex" else "% \\section{Old}", "noise")
        else:
            if kind == "html" and r.random() < 0.7:
                line("<p>")
            elif kind == "md" and r.random() < 0.15:
                line("> ")
            elif kind in ("md", "wiki") and r.random() < 0.15:
                line({"md": f"*{say(10).strip('*')}* ", "wiki": f"''{say(10)}'' "}[kind])
            inline()
        line("\n\n")
    if r.random() < (0.9 if kind == "scan" else 0.05):
        n = r.randint(1, 200)
        line(r.choice((f"- {n} -", f"{n}", f"[{n}]", f"Page {n} of 300", f"~ {n} ~", f"p. {n}", f"{n}/300")), "noise")
    return out


def labelled(pieces: list[tuple[str, str]]) -> tuple[str, list[Leaf], np.ndarray]:
    """The page of the pieces, its leaves and their labels: of the piece a leaf begins in."""
    text, starts = "".join(p for p, _ in pieces), np.cumsum([0] + [len(p) for p, _ in pieces])
    ls = leaves(text)
    y = []
    for leaf in ls:
        k = int(np.searchsorted(starts, leaf.start, "right")) - 1
        label = L[pieces[k][1]]
        y.append(label if _ALLOWED[ATOMS[leaf.atom], label] else int(np.flatnonzero(_ALLOWED[ATOMS[leaf.atom]])[0]))
    return text, ls, np.array(y, np.int64)


def train(texts: list[str], seed: int = 5, pages: int = TRAIN_PAGES) -> BiLSTM:
    """The labeller, trained on pages made of the texts."""
    r = random.Random(seed)
    texts = texts or ["A plain sentence of a page."]
    seqs, ys = [], []
    while len(seqs) < pages:
        text, ls, y = labelled(make_page(r, texts))
        if ls:
            seqs.append(features(text, ls))
            ys.append(y)
    for n in range(1, 31):  # rows of tables
        seqs.append(features("", [Leaf(0, 0, "row")] * n))
        ys.append(np.full(n, L["table_row"], np.int64))
    model = BiLSTM()
    model.fit(seqs, ys)
    return model


def fitted(spark: SparkSession, sf_dir: str) -> BiLSTM:
    """The labeller, trained on pages made of the plain texts of SAMPLE pages of each table."""
    texts: list[str] = []
    for table, key in (("page_outcomes", "out_id"), ("normalized_pages", "np_id")):
        df = read(spark, sf_dir, table, key, "markdown").where(F.length("markdown") > 0)
        for row in hashed_sample(df.select(key, F.substring("markdown", 1, SAMPLE_CHARS).alias("markdown")), key, SAMPLE).toArrow().column("markdown").to_pylist():
            texts += [t for t in re.findall(r"(?m)^(?![#*=|<>$`~{}%\\-])[^\n$\\<>`{}|=#*_]{15,}", row)]
    return train(sorted(set(texts))[:6000])


# ---- queries --------------------------------------------------------------------------------------------------


def _may_list(text: str, leaf: Leaf) -> bool:
    """Whether a hash mark can be an item: on a page with other wiki markup, or in a run of such lines."""
    end = text.find("\n", leaf.end)
    before = text[: leaf.start].rpartition("\n")[0].rpartition("\n")[2] if leaf.start else ""
    return bool(_WIKI.search(text)) or end >= 0 and text[end + 1 : end + 2] == "#" or before.startswith("#")


_MARK = re.compile(r"[ \t]*(?:[-*+•#]|\(?\w{1,3}[.)])[ \t]")


def _goes_on(text: str, leaf: Leaf) -> bool:
    """Whether a number at the head of a line belongs to a sentence of the line before: that one is neither blank nor an
    item and doesn't end a sentence."""
    before = text[: leaf.start].rpartition("\n")[0].rpartition("\n")[2] if leaf.start else ""
    return bool(before.strip()) and not _MARK.match(before) and before.rstrip()[-1] not in ".!?。！？।؟:：>”»\"=-`~|)]}"


def checked(text: str, leaf: Leaf, label: str) -> str:
    """The label a leaf keeps where its mark has two readings that its surroundings tell apart."""
    if leaf.atom == "hash" and label == "list_item" and not _may_list(text, leaf):
        return "heading"
    if leaf.atom == "number":
        return "text" if _goes_on(text, leaf) else "list_item"
    return label


def label_pages(texts: list[str], model: BiLSTM) -> list[list[tuple[Leaf, str]]]:
    """(leaf, label) of each page."""
    ls = [leaves(t) for t in texts]
    some = [i for i, x in enumerate(ls) if x]
    got = model.label([features(texts[i], ls[i]) for i in some], [np.array([ATOMS[x.atom] for x in ls[i]]) for i in some])
    out: list[list[tuple[Leaf, str]]] = [[] for _ in texts]
    for i, y in zip(some, got, strict=True):
        out[i] = [(x, checked(texts[i], x, LABELS[k])) for x, k in zip(ls[i], y, strict=True)]
    return out


ELEMENTS = ("heading", "list_item", "code_block", "formula", "table")


def _counts(df: DataFrame, rec: str, key: str, model: BiLSTM) -> DataFrame:
    """(rec, row_id, elem, n) of the pages."""

    def run(b: pa.RecordBatch) -> dict:
        out: dict = {"rec": [], "row_id": [], "elem": [], "n": []}
        ids, texts = (c.to_pylist() for c in b.columns)
        for i, page in zip(ids, label_pages(texts, model), strict=True):
            for e in ELEMENTS:
                if n := sum(y == e for _, y in page):
                    for name, v in zip(out, (rec, i, e, n), strict=True):
                        out[name].append(v)
        return out

    return arrow_map(spread(df.where(F.length("markdown") > 0)).select(key, "markdown"), run, "rec string, row_id bigint, elem string, n bigint")


def _row_counts(df: DataFrame, model: BiLSTM) -> DataFrame:
    def run(b: pa.RecordBatch) -> dict:
        ids, tables = (c.to_pylist() for c in b.columns)
        ls = [table_leaves(t) for t in tables]
        some = [i for i, x in enumerate(ls) if x]
        got = model.label([features("", ls[i]) for i in some], [np.array([ATOMS["row"]] * len(ls[i])) for i in some])
        n = [int((y == L["table_row"]).sum()) for y in got]
        return {"rec": ["tables_html"] * len(some), "row_id": [ids[i] for i in some], "elem": ["table_row"] * len(some), "n": n}

    return arrow_map(df.where(F.size("tables_html") > 0).select("np_id", "tables_html"), run, "rec string, row_id bigint, elem string, n bigint")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per structural element of each page; rows of repeated ids count once."""
    model = fitted(spark, sf_dir)
    n = _counts(read(spark, sf_dir, "page_outcomes", "out_id", "markdown"), "page_outcomes", "out_id", model)
    n = n.union(_counts(read(spark, sf_dir, "normalized_pages", "np_id", "markdown"), "normalized_pages", "np_id", model))
    n = n.union(_row_counts(read(spark, sf_dir, "normalized_pages", "np_id", "tables_html"), model))
    most = n.groupBy("rec", "row_id", "elem").agg(F.max("n").alias("n"))
    return most.select("rec", "row_id", "elem", F.explode(F.sequence(F.lit(1).cast("bigint"), "n")).alias("seq"))


_TAGS = re.compile(r"<(?!math\b)/?[a-zA-Z][^<>\n]{0,300}>")
_STRONG = re.compile(r"(\*\*|__|''')(?=\S)(.+?)(?<=\S)\1|(?<!\w)([*_]|'')(?=\S)([^*_\n]+?)(?<=\S)\3(?!\w)")
_LINK = re.compile(r"!?\[([^\]\n]*)\]\([^)\n]*\)|\[\[(?:[^|\]\n]*\|)?([^\]\n]*)\]\]|\\href\{[^}]*\}\{([^}]*)\}")
_CITE = re.compile(r"\{\{[^}\n]*\}\}|<ref\b.*?(?:</ref>|/>)|\\(?:label|cite|footnote)\{[^}]*\}", re.S)
_TEXCMD = re.compile(r"\\(?:textbf|emph|texttt|textit|underline)\{([^{}]*)\}")
_ESC = re.compile(r"\\([#*_$%&{}\[\]!.+-])")
_ENV = re.compile(r"\\(?:begin|end)\{(?:itemize|enumerate|document|center|quote)\}(?:\[[^\]]*\])?")


def _inline(s: str) -> str:
    """Running text without marks."""
    s = _CITE.sub("", s)
    s = _LINK.sub(lambda m: m.group(1) or m.group(2) or m.group(3) or "", s)
    s = _ENV.sub("", _TEXCMD.sub(r"\1", s))
    s = _STRONG.sub(lambda m: m.group(2) or m.group(4), s)
    return html.unescape(_ESC.sub(r"\1", _TAGS.sub("", s))).replace("\xa0", " ")


def clean(text: str, page: list[tuple[Leaf, str]]) -> str:
    """The page as clean text: '# ' headings, '- ' items, fenced code, $$ formulas, ' | ' rows."""
    out: list[str] = []
    covered = 0
    for k, (leaf, y) in enumerate(page):
        if leaf.start < covered:
            continue
        s = text[leaf.start : leaf.end]
        if y == "noise":
            continue
        glue = "\n\n" if text[max(covered, 0) : leaf.start].count("\n") > 1 else "\n" if "\n" in text[covered : leaf.start] else ""
        covered = leaf.end
        if y == "heading":
            out.append("\n\n# " + (_inline(s.split("\n")[0].strip()) if leaf.atom == "setext" else ""))
        elif y == "list_item":
            out.append(("\n\n" if glue == "\n\n" else "\n") + "- ")
        elif y == "code_block":
            body = re.sub(r"\A[ \t]*(?:`{3,}|~{3,})[^\n]*\n|\n?[ \t]*(?:`{3,}|~{3,})[ \t]*\Z|\A\\begin\{\w+\}(?:\[[^\]]*\])?\n?|\\end\{\w+\}\Z|\A(?:<[^>]*>)+\n?|(?:</[^>]*>)+\Z", "", s)
            out.append("\n\n```\n" + (html.unescape(body) if "<" in s[:1] else body).strip("\n") + "\n```\n\n")
        elif y == "formula":
            body = re.sub(r"\A(?:\$\$?|\\[\[(]|\\begin\{[^}]*\}|<math[^>]*>)\s*|\s*(?:\$\$?|\\[\])]|\\end\{[^}]*\}|</math\s*>)\Z", "", s, flags=re.I)
            out.append(f"{glue}${body}$" if leaf.atom in ("math_in", "math_dollar") else f"{glue}$${body}$$")
        elif y == "table":
            out.append("\n\n" + _table(s, leaf.atom) + "\n\n")
        else:
            s = s[1:-1] if leaf.atom == "tick" else s
            head = out and out[-1].endswith(("# ", "- "))
            body = _inline(s if leaf.atom != "quote" else "")
            if k and page[k - 1][1] == "heading" and head:
                body = re.sub(r"\s*[=#}]+\s*\Z", "", body)
            out.append(("" if head else glue) + (body.strip() if head else body))
    return re.sub(r"\n{3,}", "\n\n", "".join(out)).strip()


def _table(s: str, atom: str) -> str:
    if atom == "html_table":
        rows = [re.split(r"<t[dh]\b[^>]*>", x, flags=re.I)[1:] for x in re.split(r"<tr\b[^>]*>", s, flags=re.I)[1:]]
    elif atom == "wiki_table":
        rows = [re.split(r"\|\||!!", re.sub(r"(?m)^[|!]", "", x).strip().replace("\n", "||")) for x in re.split(r"(?m)^\|-.*$|^\{\|.*$|^\|\}.*$", s) if x.strip()]
    elif atom == "tex_table":
        rows = [x.split("&") for x in re.sub(r"\A\\begin\{\w+\}(?:\{[^}]*\})?|\\end\{\w+\}\Z|\\hline", "", s).split("\\\\") if x.strip()]
    else:
        rows = [x.strip().strip("|").split("|") for x in s.split("\n") if x.strip(" |:-\t")]
    return "\n".join(" | ".join(_inline(c).strip() for c in r) for r in rows)


def p4_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec, row_id, text): each non-blank page as clean text; of repeated ids one row per distinct text."""
    model = fitted(spark, sf_dir)

    def one(table: str, key: str) -> DataFrame:
        def run(b: pa.RecordBatch) -> dict:
            ids, texts = (c.to_pylist() for c in b.columns)
            return {"rec": [table] * len(ids), "row_id": ids, "text": [clean(t, p) for t, p in zip(texts, label_pages(texts, model), strict=True)]}

        df = read(spark, sf_dir, table, key, "markdown").where(F.length("markdown") > 0)
        return arrow_map(spread(df), run, "rec string, row_id bigint, text string")

    return one("page_outcomes", "out_id").union(one("normalized_pages", "np_id")).distinct()

