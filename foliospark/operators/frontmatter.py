"""Rule files: a fenced head in a small subset of YAML, read into rules for operators.rules.

The subset: block mappings and sequences by indentation, flow mappings and lists on one line, quoted and plain scalars,
comments. A file needs `id` and `version`, and each rule `id`, `when` and `then`; anything else is an error.
"""

from __future__ import annotations

import hashlib
import re
from typing import Any

_INT, _FLOAT = re.compile(r"[-+]?\d+"), re.compile(r"[-+]?\d*\.\d+")


def scalar(s: str) -> Any:
    s = s.strip()
    if len(s) > 1 and s[0] == s[-1] and s[0] in "'\"":
        return s[1:-1].replace("''", "'") if s[0] == "'" else s[1:-1]
    if s in ("", "null", "~"):
        return None
    if s in ("true", "false"):
        return s == "true"
    return int(s) if _INT.fullmatch(s) else float(s) if _FLOAT.fullmatch(s) else s


class _Flow:
    """A one-line value."""

    def __init__(self, s: str):
        self.s, self.i = s, 0

    def value(self) -> Any:
        self._space()
        c = self.s[self.i : self.i + 1]
        return self._map() if c == "{" else self._list() if c == "[" else scalar(self._plain(",}]"))

    def _space(self):
        while self.s[self.i : self.i + 1].isspace():
            self.i += 1

    def _plain(self, stop: str) -> str:
        a = self.i
        if self.s[a : a + 1] in ("'", '"'):
            q = self.s[a]
            self.i += 1
            while self.i < len(self.s) and not (self.s[self.i] == q and self.s[self.i + 1 : self.i + 2] != q):
                self.i += 2 if self.s[self.i] == q else 1
            self.i += 1
        else:
            while self.i < len(self.s) and self.s[self.i] not in stop:
                self.i += 1
        return self.s[a : self.i]

    def _list(self) -> list:
        self.i += 1
        out = []
        while True:
            self._space()
            if self.s[self.i : self.i + 1] == "]":
                self.i += 1
                return out
            if self.i >= len(self.s):
                raise ValueError(f"a list isn't closed: {self.s}")
            out.append(self.value())
            self._space()
            self.i += self.s[self.i : self.i + 1] == ","

    def _map(self) -> dict:
        self.i += 1
        out = {}
        while True:
            self._space()
            if self.s[self.i : self.i + 1] == "}":
                self.i += 1
                return out
            if self.i >= len(self.s):
                raise ValueError(f"a mapping isn't closed: {self.s}")
            key = str(scalar(self._plain(":")))
            self.i += 1
            out[key] = self.value()
            self._space()
            self.i += self.s[self.i : self.i + 1] == ","


def _uncommented(line: str) -> str:
    quote = None
    for i, c in enumerate(line):
        if quote:
            quote = None if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c == "#" and (i == 0 or line[i - 1].isspace()):
            return line[:i].rstrip()
    return line.rstrip()


def _block(lines: list[tuple[int, str]], at: int, depth: int) -> tuple[Any, int]:
    if lines[at][1].startswith("- "):
        out: list = []
        while at < len(lines) and lines[at][0] == depth and lines[at][1].startswith("- "):
            out.append(_Flow(lines[at][1][2:]).value())
            at += 1
        return out, at
    got: dict = {}
    while at < len(lines) and lines[at][0] == depth:
        key, colon, rest = lines[at][1].partition(":")
        if not colon:
            raise ValueError(f"no mapping: {lines[at][1]}")
        at += 1
        if rest.strip():
            got[key.strip()] = _Flow(rest).value()
        elif at < len(lines) and (lines[at][0] > depth or lines[at][1].startswith("- ")):
            got[key.strip()], at = _block(lines, at, lines[at][0])
        else:
            got[key.strip()] = None
    return got, at


def parse(text: str) -> dict[str, Any]:
    """The head of a rule file, with the file's sha256."""
    m = re.match(r"---\n(.*?)\n---(?:\n|\Z)", text, re.S)
    if not m:
        raise ValueError("no head between lines of three hyphens")
    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in map(_uncommented, m.group(1).split("\n")) if x.strip()]
    head, at = _block(lines, 0, 0) if lines else ({}, 0)
    if at < len(lines):
        raise ValueError(f"wrong indentation: {lines[at][1]}")
    for key in ("id", "version"):
        if not head.get(key):
            raise ValueError(f"{key} is missing")
    for rule in head.get("rules") or ():
        if not isinstance(rule, dict) or {"id", "when", "then"} - set(rule):
            raise ValueError(f"a rule needs id, when and then: {rule}")
    return head | {"sha256": hashlib.sha256(text.encode()).hexdigest()}
