"""Text flow of pages: wrapped lines folded, headings relevelled, blocks aligned, boxes clustered, tables compared.

Plain functions of one page or table, used through Arrow maps; each states what it does with empty input.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

#: What begins a unit that is never folded into the line before.
UNIT_START = re.compile(r"\s*(?:#|\||>|```|~~~|!\[|<|\$\$|[-*+•]\s|\d{1,3}[.)]\s|[（(][0-9０-９]{1,3}[）)]|[①-⑳])")
CJK = re.compile(r"[぀-ヿ㐀-鿿]")
HEADING_LIKE = re.compile(r"\s*(?:#|（[0-9０-９]+）|[①-⑳])")
ENDS = "。．.!?！？:：;；"


def reflow(text: str) -> str:
    """Wrapped lines folded into paragraphs; between characters of scripts without spaces no space is put."""
    out: list[str] = []
    fenced = False
    for line in text.split("\n"):
        mark = line.lstrip().startswith(("```", "~~~"))
        prev = out[-1] if out else ""
        keep = fenced or mark or not line.strip() or not prev.strip() or UNIT_START.match(line) or HEADING_LIKE.match(prev) or prev.lstrip().startswith(("|", "```", "~~~", "<", "$$")) or prev.rstrip()[-1:] in ENDS
        if mark:
            fenced = not fenced
        if keep:
            out.append(line)
        else:
            a, b = prev.rstrip(), line.lstrip()
            out[-1] = a + ("" if CJK.match(a[-1:]) and CJK.match(b[:1]) else " ") + b
    return "\n".join(out)


def merge_paragraphs(blocks: list[dict]) -> list[dict]:
    """Adjacent body blocks of one page folded where the first goes on: no end mark, no unit start, boxes that overlap
    sideways with a gap of -2 to 1.6 lines. Rows of {kind, text, bbox}; the merged box is the union."""
    out: list[dict] = []
    for b in blocks:
        a = out[-1] if out else None
        go = bool(a and a["kind"] in ("paragraph", "text block") and b["kind"] in ("paragraph", "text block") and a["text"] and b["text"] and a["bbox"] and b["bbox"])
        if go:
            p, q = a["bbox"], b["bbox"]
            height = max(1.0, (q[3] - q[1]) / max(1, b["text"].count("\n") + 1))
            gap = p[1] - q[3]
            go = a["text"].rstrip()[-1:] not in ENDS and not UNIT_START.match(b["text"]) and min(p[2], q[2]) > max(p[0], q[0]) and -2 <= gap <= 1.6 * height
        if go:
            x, y = a["text"].rstrip(), b["text"].lstrip()
            out[-1] = a | {"text": x + ("" if CJK.match(x[-1:]) and CJK.match(y[:1]) else " ") + y, "bbox": [min(p[0], q[0]), min(p[1], q[1]), max(p[2], q[2]), max(p[3], q[3])]}
        else:
            out.append(b)
    return out


def align(blocks: list[str], lines: list[str], least: int = 10, least_block: int = 8) -> list[int | None]:
    """For each block the line that shares its longest beginning, one line for one block, in block order; of equals the first."""
    left = dict(enumerate(lines))
    out: list[int | None] = []
    for b in blocks:
        best, at = least - 1, None
        if len(b) >= least_block:
            for i, s in left.items():
                n = next((k for k, (x, y) in enumerate(zip(b, s)) if x != y), min(len(b), len(s)))
                if n > best:
                    best, at = n, i
        out.append(at)
        if at is not None:
            del left[at]
    return out


def clusters(boxes: list[list[float]], gap: float = 12.0) -> list[int]:
    """The group of each box: boxes that touch when both are widened by half the gap belong together. Swept from left to right."""
    parent = list(range(len(boxes)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    order = sorted(range(len(boxes)), key=lambda i: boxes[i][0])
    active: list[int] = []
    for i in order:
        x0, y0, _, y1 = boxes[i]
        active = [j for j in active if boxes[j][2] + gap >= x0]
        for j in active:
            if boxes[j][1] <= y1 + gap and y0 <= boxes[j][3] + gap:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
        active.append(i)
    return [root(i) for i in range(len(boxes))]


def figures(paths, tables, texts, width: float, height: float, least_paths: int = 8, gap: float = 12.0, pad: float = 14.0, least_area: float = 2500.0, most_cover: float = 0.35, most_page: float = 0.8) -> list[list[float]]:
    """Boxes of vector figures: clusters of enough paths outside tables, neither small nor a whole page nor full of text."""
    inside = lambda p: any(t[0] - 6 <= (p[0] + p[2]) / 2 <= t[2] + 6 and t[1] - 6 <= (p[1] + p[3]) / 2 <= t[3] + 6 for t in tables)
    free = [p for p in paths if not inside(p)]
    groups: dict[int, list] = {}
    for p, g in zip(free, clusters(free, gap), strict=True):
        groups.setdefault(g, []).append(p)
    out = []
    for ps in groups.values():
        if len(ps) < least_paths:
            continue
        b = [max(0.0, min(p[0] for p in ps) - pad), max(0.0, min(p[1] for p in ps) - pad), min(width, max(p[2] for p in ps) + pad), min(height, max(p[3] for p in ps) + pad)]
        area = max(0.0, b[2] - b[0]) * max(0.0, b[3] - b[1])
        cover = sum(max(0.0, min(b[2], t[2]) - max(b[0], t[0])) * max(0.0, min(b[3], t[3]) - max(b[1], t[1])) for t in texts)
        if area >= least_area and area <= most_page * width * height and min(1.0, cover / area) <= most_cover:
            out.append(b)
    return sorted(out, key=lambda b: -b[3])


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__()
        self.root: tuple[str, list] = ("table", [])
        self.row: list | None = None
        self.cell: list | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.row = []
            self.root[1].append(("tr", self.row))
            self.cell = None
        elif tag in ("td", "th"):
            if self.row is None:
                self.handle_starttag("tr", [])
            self.cell = [""]
            span = dict(attrs)
            self.row.append((f"td {span.get('rowspan') or 1} {span.get('colspan') or 1}", self.cell))

    def handle_data(self, data):
        if self.cell is not None:
            self.cell[0] += data


def _chars(a: str, b: str) -> float:
    """Edit distance of two texts over the longer one's length."""
    if a == b:
        return 0.0
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1] / max(len(a), len(b))


def _sequence(a: list, b: list, drop, put, swap) -> float:
    row = [0.0]
    for y in b:
        row.append(row[-1] + put(y))
    for x in a:
        new = [row[0] + drop(x)]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + drop(x), new[-1] + put(y), row[j] + swap(x, y)))
        row = new
    return row[-1]


def table_similarity(a: str, b: str) -> float:
    """1 - edit distance of two table trees over the larger one's nodes. Rows match rows and cells cells, which for trees of
    this depth is their tree distance with nodes kept on their level. Two empty tables are equal."""
    t, u = _Tree(), _Tree()
    t.feed(a or "")
    u.feed(b or "")
    rows, other = t.root[1], u.root[1]
    nodes = lambda rs: 1 + sum(1 + len(cells) for _, cells in rs)
    cell = lambda x, y: 1.0 if x[0] != y[0] else _chars(x[1][0].strip(), y[1][0].strip())
    one = lambda _: 1.0
    row = lambda r: 1.0 + len(r[1])
    d = _sequence(rows, other, row, row, lambda x, y: _sequence(x[1], y[1], one, one, cell))
    return 1 - d / max(nodes(rows), nodes(other))


def match_tables(gold: list[tuple[str | None, str]], got: list[tuple[str | None, str]]) -> list[float]:
    """The similarity of each gold table (label, HTML) with its match: the first unused of equal label, else the most similar unused."""
    free = list(range(len(got)))
    key = lambda s: (s or "").strip().lower()
    out = []
    for label, html in gold:
        same = next((i for i in free if key(label) and key(got[i][0]) == key(label)), None)
        scores = {i: table_similarity(html, got[i][1]) for i in ([same] if same is not None else free)}
        best = max(scores, key=lambda i: (scores[i], -i), default=None)
        out.append(scores[best] if best is not None else 0.0)
        if best is not None:
            free.remove(best)
    return out


_LOWER = re.compile(r"[a-zà-ÿа-яё]")
_NUMBERED = re.compile(r"^(#{1,6})\s+(\d+(?:\.\d+)*)[.)]?(?=\s+\D)")


def stitch(pages: list[str | None]) -> str:
    """Pages in order as one text, an invisible mark at each break. A last paragraph without an end mark goes on in the next
    page's first one where that begins in small letters or both are of a script without spaces; a broken word is joined."""
    out = ""
    for k, page in enumerate(p for p in pages if p and p.strip()):
        mark, body = f"<!-- page {k + 1} -->", page.strip("\n")
        if not out:
            out = f"{mark}\n\n{body}"
            continue
        a, b = out.rstrip(), body.lstrip()
        tail = a[a.rfind("\n") + 1 :]
        open_end = a[-1] not in ENDS and not UNIT_START.match(tail) and not UNIT_START.match(b)
        if open_end and a[-1] == "-" and _LOWER.match(b):
            out = f"{a[:-1]}{mark}{b}"
        elif open_end and _LOWER.match(b):
            out = f"{a} {mark}{b}"
        elif open_end and CJK.match(a[-1]) and CJK.match(b):
            out = f"{a}{mark}{b}"
        else:
            out = f"{a}\n\n{mark}\n\n{b}"
    return out


def relevel(text: str) -> str:
    """Markdown headings with a decimal number at the level of its depth, six at most; others and fenced lines as they are."""
    out, fenced = [], False
    for line in text.split("\n"):
        if line.lstrip().startswith(("```", "~~~")):
            fenced = not fenced
        m = None if fenced else _NUMBERED.match(line)
        out.append("#" * min(6, m.group(2).count(".") + 1) + line[m.end(1) :] if m else line)
    return "\n".join(out)
